"""Conversation repair against a search over all edits, on small awkward tables."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from inspectlake.llm import conversations, queries

COLUMNS = "conv_id long, turn long, role string, text string, audit string, Kind int"


def cheapest(rows):
    """(cost, audit, repaired rows) by uniform-cost search over single edits; rows are (role, text, fault)."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, kept = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, list(kept)
        if (at, last) in done:
            continue
        done.add((at, last))
        for role in ("user", "assistant"):
            if role[0] in follows[last]:
                heapq.heappush(heap, (cost + 5, audit + "I", at, role[0], (*kept, (role, ""))))
                if at < len(rows) and rows[at][2] not in ("blank", "duplicate"):
                    late = 5 * (rows[at][2] == "truncated")
                    heapq.heappush(heap, (cost + 1 + late, audit + "R", at + 1, role[0], (*kept, (role, rows[at][1]))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, last, kept))
            if fault not in ("blank", "duplicate") and role[:1] and role[0] in follows[last]:
                late = 5 * (fault == "truncated")
                heapq.heappush(heap, (cost + late, audit + "K", at + 1, role[0], (*kept, (role, text))))
    raise AssertionError


def plain(table):
    """The contract of op11 row by row."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text, *_ in (r for r in table if r[0] == conv):
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
            rows += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        judged, seen = [], set()
        for _, role, text in rows:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = {t for t, *_ in rows if t is not None}
        cost, audit, kept = cheapest(judged)
        faults = [f for *_, f in judged]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(judged, judged[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return out


def awkward(rng, n):
    texts = ["Yes.", "No!", "so", "", " \t", "Well?  \n", "Ü.", None, "a.b", "x" * 5000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "useful", "ärger"]
    rows = []
    for conv in [None, *range(n)]:
        rows += [(conv, rng.choice([t, t, t, None, t + 2, -t]), rng.choice(roles), rng.choice(texts), "x", 1) for t in range(rng.randint(1, 7))]
    return rows + rows[:9]


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_search_over_edits(spark, tmp_path, seed):
    rows = awkward(random.Random(seed), 120)
    rows += [(1000, t, ("user", "assistant")[t % 2], f"t{t % 3}.", "x", 1) for t in range(60)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op11_conversation_repair(spark, str(tmp_path)).collect()
    expected = plain(rows)
    assert len(got) == len(expected)
    for r in got:
        assert tuple(r)[1:] == expected[r.conv_id], r.conv_id


def test_empty_table_and_conversation_without_rows(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op11_conversation_repair(spark, str(tmp_path)).count() == 0
    dropped = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    spark.createDataFrame([(7, dropped, "user", "Hi.", "", 1)], COLUMNS).write.parquet(str(tmp_path / "one/conversations.parquet"))
    (row,) = queries.op11_conversation_repair(spark, str(tmp_path / "one")).collect()
    assert tuple(row) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_ends_are_shared_and_nodes_few():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("suaoxSUAO", k=rng.randint(0, 40))) for _ in range(500)}, key=lambda w: w[::-1])
    path, fresh = conversations.Path(), []
    for word in words:
        answer = path.solve(word)
        fresh.append(conversations.Path().solve(word) == answer)
        rows = [({"o": "tool"}.get(c.lower(), c.lower()), "", "blank" if c == "x" else "truncated" if c.isupper() else "") for c in word]
        assert cheapest(rows)[:2] == answer
    assert all(fresh) and len(path.automaton.costs) < 200


def test_long_conversation_is_read_in_one_pass():
    signature = "su" + "au" * 100_000 + "x"
    cost, audit = conversations.Path().solve(signature)
    assert cost == 4 and audit.count("D") == 2 and len(audit) == len(signature)


def test_repaired_rows_follow_the_grammar(spark):
    turns = spark.createDataFrame(awkward(random.Random(5), 40), COLUMNS)
    found = conversations.report(turns)
    rows = conversations.repaired(turns, found.select("conv_id", "audit")).collect()
    texts = {}
    for r in rows:
        texts.setdefault(r.conv_id, []).append(r)
    for own in texts.values():
        assert [r.position for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in own))
