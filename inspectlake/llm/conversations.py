"""Repair of conversation structure over an automaton of shared suffixes.

Every row of a conversation becomes one symbol: the class of its role and its
fault.  The string of symbols is the conversation's signature.  What the rest
of a conversation costs depends on that rest alone, so signatures are read from
their ends: equal ends are one path, and ends that lead to the same costs and
edits from every grammar state are one node of a minimal acyclic automaton.
Cost-to-go and the next best edit are computed once per node and grammar state;
the best audit is read along the path.

Distinct signatures are dealt by ranges of their reversed text, so those that
share an end meet, whatever conversation they come from.  A conversation with
very many rows passes its tasks as a sorted stream: only its signature and a
node number a row are held.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectlake.llm.staging import stage

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
#: Grammar states of ``(s?(ua)+)?``: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, DONE = range(4)
STATES = (START, SYSTEM, USER, DONE)
#: Where a kept row leads, by state and initial of its role.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
#: Where an inserted or reroled row leads, and its role.
PUT = (USER, USER, DONE, USER)
PUT_ROLE = ("user", "user", "assistant", "user")
LEGAL = {"su", "ua", "au"}
#: Symbol of a row that has to go; others are s, u, a, o (any other role), in capitals if truncated.
GONE = "x"
LONGEST_LONG = 2**63 - 1

_SPACES = r" \t\n\u000b\u000c\r"
#: Of the rows of a conversation; Spark sorts nulls first.
ORDER = ["turn", "role", "text"]


class Automaton:
    """Interned nodes: relative cost-to-go and best next edit by grammar state."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.costs: list[tuple[int, ...]] = []
        self.edits: list[str] = []
        self.steps: dict[tuple[str, int], tuple[int, int]] = {}
        ends = {START: (0, ""), DONE: (0, "")}
        self.end, _ = self._node([ends.get(q) for q in STATES])

    def _node(self, best: list[tuple[int, str] | None]) -> tuple[int, int]:
        """Number and least cost of the node with these (cost, edit), once inserting is allowed too.

        At one state every edit leads elsewhere, so of equally cheap audits
        the least begins with the least letter; inserts cost, so none cycles.
        """
        for _ in STATES:
            for q in STATES:
                if best[PUT[q]] is not None:
                    put = (best[PUT[q]][0] + INSERT_COST, INSERT)
                    best[q] = put if best[q] is None else min(best[q], put)
        least = min(cost for cost, _ in best)
        node = tuple(cost - least for cost, _ in best), "".join(edit or "." for _, edit in best)
        if node not in self.known:
            self.known[node] = len(self.costs)
            self.costs.append(node[0])
            self.edits.append(node[1])
        return self.known[node], least

    def before(self, symbol: str, node: int) -> tuple[int, int]:
        """The node one symbol earlier, and what its least cost adds."""
        if (symbol, node) not in self.steps:
            later, role = self.costs[node], symbol.lower()
            late = TRUNCATED_COST if symbol != role else 0
            best = []
            for q in STATES:
                ways = [(DELETE_COST + later[q], DELETE)]
                if symbol != GONE:
                    ways.append((REROLE_COST + late + later[PUT[q]], REROLE))
                    if (q, role) in KEPT:
                        ways.append((late + later[KEPT[q, role]], KEEP))
                best.append(min(ways))
            self.steps[symbol, node] = self._node(best)
        return self.steps[symbol, node]


class Path:
    """Nodes of the suffixes of one signature; the next signature keeps those it shares."""

    def __init__(self):
        self.automaton = Automaton()
        self.backward = ""
        self.nodes, self.least = array("i", [self.automaton.end]), array("q", [0])

    def solve(self, signature: str) -> tuple[int, str]:
        """Cost and audit of the cheapest repair, the least audit among equals."""
        backward = signature[::-1]
        shared, most = 0, min(len(backward), len(self.backward))
        while shared < most and backward[shared] == self.backward[shared]:
            shared += 1
        del self.nodes[shared + 1 :], self.least[shared + 1 :]
        for symbol in backward[shared:]:
            node, more = self.automaton.before(symbol, self.nodes[-1])
            self.nodes.append(node)
            self.least.append(self.least[-1] + more)
        self.backward = backward
        return self.least[-1] + self.automaton.costs[self.nodes[-1]][START], self._audit(signature)

    def _audit(self, signature: str) -> str:
        out, state, edits = bytearray(), START, self.automaton.edits
        for at in range(len(signature) + 1):
            edit = edits[self.nodes[len(signature) - at]][state]
            while edit == INSERT:
                out += b"I"
                state = PUT[state]
                edit = edits[self.nodes[len(signature) - at]][state]
            if edit == ".":
                break
            out += edit.encode()
            if edit != DELETE:
                state = PUT[state] if edit == REROLE else KEPT[state, signature[at].lower()]
        return out.decode()


def marked(turns: DataFrame, absent: str) -> DataFrame:
    """Rows with ``mark``: the initial class of the role and the first fault; null where absent.

    All rows of a conversation lie in one partition, in order.
    """
    rows = turns.select(
        "conv_id",
        F.expr(f"if({absent}, null, turn)").cast("long").alias("turn"),
        F.expr(f"if({absent}, null, coalesce(role, ' '))").alias("role"),
        F.expr(f"if({absent}, null, coalesce(text, ' '))").alias("text"),
    ).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    end = f"trim(TRAILING '{_SPACES}' FROM text)"
    mark = f"""if(role is null, null, concat(
        case left(role, 1) when 's' then 's' when 'u' then 'u' when 'a' then 'a' else 'o' end,
        case when {end} = '' then 'b' when seen > 1 then 'd' when right({end}, 1) not in ('.', '!', '?') then 't' else 'k' end))"""
    return rows.withColumn("seen", seen).withColumn("mark", F.expr(mark)).sortWithinPartitions("conv_id", *ORDER)


REPORT = "signature string, gaps long, blank long, duplicate long, truncated long, illegal long"


def signatures(turns: DataFrame, absent: str = "false") -> DataFrame:
    """One row per conversation: signature, gaps in its turns and counts of faults."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = [], None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "mark"))
            for conv, turn, mark in zip(*columns, strict=True):
                if now is None or conv != now.conv:
                    if now:
                        out.append(now.row())
                    now = _Reading(conv)
                if mark:
                    now.add(turn, mark)
            yield _batch(out, schema)
            out.clear()
        if now:
            yield _batch([now.row()], schema)

    schema = T.StructType([turns.schema["conv_id"], *T.StructType.fromDDL(REPORT).fields])
    return marked(turns, absent).select("conv_id", "turn", "mark").mapInArrow(run, schema)


class _Reading:
    def __init__(self, conv):
        self.conv, self.symbols, self.role = conv, bytearray(), ""
        self.first = self.last = None
        self.turns = self.illegal = 0
        self.faults = {"b": 0, "d": 0, "t": 0, "k": 0}

    def add(self, turn, mark):
        role, fault = mark
        self.illegal += bool(self.symbols) and self.role + role not in LEGAL
        self.role = role
        self.faults[fault] += 1
        self.symbols += (GONE if fault in "bd" else role.upper() if fault == "t" else role).encode()
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1

    def row(self):
        gaps = 0 if self.first is None else min(LONGEST_LONG, self.last - self.first + 1 - self.turns)
        faults = [self.faults[f] for f in "bdt"]
        return (self.conv, self.symbols.decode(), gaps, *faults, self.illegal)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def solved(found: DataFrame) -> DataFrame:
    """(signature, cost, audit) of every distinct signature, in ranges of shared ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = Path()
        for batch in batches:
            texts = batch.column("signature").to_pylist()
            answers = [path.solve(s) for s in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("signature"), pa.array([c for c, _ in answers], pa.int64()), pa.array([a for _, a in answers], pa.string())],
                names=["signature", "cost", "audit"],
            )

    backward = F.reverse("signature")
    distinct = found.select("signature").distinct().repartitionByRange(backward).sortWithinPartitions(backward)
    return distinct.mapInArrow(run, "signature string, cost long, audit string")


def report(turns: DataFrame, absent: str = "false") -> DataFrame:
    """conv_id, signature, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation.

    ``turns`` has conv_id, turn, role and text; other columns are ignored.  Rows
    for which ``absent`` (SQL) holds only name their conversation.  Rows go by
    turn, nulls first, then role, then text; a null role or text counts as one
    space, and rows without conv_id are one conversation.  A conversation
    without rows has zeros and an empty audit; an empty table gives no rows.
    """
    found = stage(signatures(turns, absent), "signatures")
    return found.join(solved(found), "signature").select("conv_id", *(f.name for f in T.StructType.fromDDL(REPORT)), "cost", "audit")


def repaired(turns: DataFrame, audits: DataFrame, absent: str = "false") -> DataFrame:
    """conv_id, position (from 0), role, text, edit: the rows after the edits of ``audits`` (conv_id, audit).

    A conversation lies in one partition, in order; a deleted one has no rows.
    """
    rows = turns.filter(f"not ({absent})").select(
        "conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"),
        F.expr("coalesce(role, ' ')").alias("role"), F.expr("coalesce(text, ' ')").alias("text"), F.lit(None).cast("string").alias("audit"),
    )
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))]
    heads = audits.select("conv_id", F.lit(0).alias("kind"), *none, "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                conv, kind, _, role, text, audit = row
                if kind == 0:
                    if now:
                        now.rest(out)
                    now = _Editing(conv, audit)
                else:
                    now.edit(role, text, out)
            yield _batch(out, schema)
        if now:
            now.rest(out := [])
            yield _batch(out, schema)

    schema = T.StructType([turns.schema["conv_id"], *T.StructType.fromDDL("position long, role string, text string, edit string").fields])
    sorted_rows = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    return sorted_rows.mapInArrow(run, schema)


class _Editing:
    def __init__(self, conv, audit):
        self.conv, self.audit, self.at, self.position, self.state = conv, audit, 0, 0, START

    def _put(self, text, edit, out):
        self._emit(PUT_ROLE[self.state], text, edit, out)
        self.state = PUT[self.state]

    def _emit(self, role, text, edit, out):
        out.append((self.conv, self.position, role, text, edit))
        self.position += 1

    def rest(self, out):
        """Inserts before the next row, or at the end."""
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self._put("", INSERT, out)
            self.at += 1

    def edit(self, role, text, out):
        self.rest(out)
        edit = self.audit[self.at]
        self.at += 1
        if edit == REROLE:
            self._put(text, edit, out)
        elif edit == KEEP:
            self._emit(role, text, edit, out)
            self.state = KEPT[self.state, role[:1]]
