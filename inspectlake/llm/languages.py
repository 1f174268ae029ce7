"""Language identification by words, with backoff to character n-grams.

The model is fitted by Spark on a bounded sample of labelled documents: counts
of lower-cased words and of character n-grams for each language, pruned to a
bounded number of entries.  A known word scores its log frequency in each
language.  An unseen word is covered from the left by the longest known
n-grams, from ``LONGEST`` characters down to one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectlake.llm.staging import stage

#: Bounds of the model: documents sampled (expected number), words and n-grams kept.
SAMPLE_DOCS = 20_000
KEPT_WORDS = 60_000
KEPT_GRAMS = 60_000
LONGEST = 5
#: Characters of one token that form a word; longer ones are only seen as n-grams.
WORD_CHARS = 40
#: Tokens a worker remembers between documents; the memory is emptied when full.
REMEMBERED = 300_000
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def fit(labelled: DataFrame, seed: int = 7, sample_docs: int = SAMPLE_DOCS) -> dict:
    """A model from (text, lang); rows without text or language teach nothing.

    About ``sample_docs`` documents are taken by a seeded hash of the text,
    all of them if there are no more.  Without any labelled document the model
    knows no language.
    """
    usable = labelled.filter("text is not null and lang is not null").select("text", "lang")
    share = min(1.0, sample_docs / max(1, usable.count()))
    spread = F.xxhash64(F.lit(seed), "text") / F.lit(2.0**64) + F.lit(0.5)
    words = stage(
        usable.filter(spread < share)
        .selectExpr("lang", r"explode(split(lower(text), '[^\\p{L}\\p{M}]+')) as word")
        .filter(f"word != '' and length(word) <= {WORD_CHARS}")
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n")),
        "words",
    )
    cut = " union all ".join(
        f"select lang, {k} as k, explode(transform(sequence(1, length(w) - {k - 1}), i -> substr(w, i, {k}))) as g, n "
        f"from {{words}} where length(w) >= {k}"
        for k in range(1, LONGEST + 1)
    )
    marked = words.selectExpr("lang", "concat(' ', word, ' ') as w", "n")
    grams = words.sparkSession.sql(cut, words=marked).filter("g != ' '").groupBy("lang", "k", "g").agg(F.sum("n").alias("n"))
    grams = stage(grams, "grams")
    totals = {r[0]: r[1] for r in words.groupBy("lang").agg(F.sum("n")).collect()}
    gram_totals = {(r[0], r[1]): r[2] for r in grams.groupBy("lang", "k").agg(F.sum("n")).collect()}
    langs = sorted(totals)
    return {
        "langs": langs,
        "words": _table(_top(words.selectExpr("lang", "word as g", "n"), KEPT_WORDS), langs, lambda g, k: totals[k]),
        "grams": _table(
            _top(grams.select("lang", "g", "n"), KEPT_GRAMS), langs, lambda g, k: gram_totals[k, len(g)]
        ),
    }


def _top(counts: DataFrame, most: int):
    """(entry, {lang: count}) of the ``most`` frequent entries seen at least twice."""
    ranked = counts.groupBy("g").agg(F.sum("n").alias("t"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    return ranked.filter("t > 1").orderBy(F.desc("t"), "g").limit(most).select("g", "by").collect()


def _table(rows, langs, total) -> dict[str, tuple[float, ...]]:
    """Centred log frequencies with half a count added, so an entry equal in all languages says nothing."""
    out = {}
    for r in rows:
        logs = [math.log((r["by"].get(k, 0) + 0.5) / (total(r["g"], k) + 1)) for k in langs]
        mean = sum(logs) / len(logs)
        out[r["g"]] = tuple(x - mean for x in logs)
    return out


class Scorer(dict):
    """Row number in ``scores`` of each token; unknown tokens are scored when first met."""

    def __init__(self, model: dict):
        super().__init__()
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.clear()
        width = len(self.model["langs"])
        self.scores, self.filled = np.zeros((1024, width + 1)), 0

    def vector(self, token: str) -> tuple[list[float], bool]:
        """Summed evidence by language, and whether the token has a letter."""
        words, grams = self.model["words"], self.model["grams"]
        parts = [token] if token.isalpha() else _LETTERS.findall(token)
        total = [0.0] * len(self.model["langs"])
        for word in parts:
            known = words.get(word) or self._cover(f" {word} ", grams)
            if known:
                total = [a + b for a, b in zip(total, known, strict=True)]
        return total, bool(parts)

    @staticmethod
    def _cover(text: str, grams: dict) -> list[float] | None:
        """Mean evidence of the longest known n-grams from each place, as much as one word may say."""
        hits = []
        for at in range(len(text)):
            for k in range(min(LONGEST, len(text) - at), 0, -1):
                hit = grams.get(text[at : at + k])
                if hit is not None:
                    hits.append(hit)
                    break
        return [sum(x) / len(hits) for x in zip(*hits, strict=True)] if hits else None

    def __missing__(self, token: str) -> int:
        total, letters = self.vector(token)
        if self.filled == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[self.filled, :-1] = total
        self.scores[self.filled, -1] = letters
        self.filled += 1
        if len(token) <= WORD_CHARS:
            self[token] = self.filled - 1
        return self.filled - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        langs = self.model["langs"]
        tokens = (text or "").lower().split()
        if self.filled > REMEMBERED:
            self.forget()
        rows = [self[t] for t in tokens]
        if not rows or not langs:
            return UNKNOWN, 0.0
        sums = self.scores[rows].sum(axis=0)
        if not sums[-1]:
            return UNKNOWN, 0.0
        odds = np.exp(sums[:-1] - sums[:-1].max())
        best = int(odds.argmax())
        return langs[best], float(odds[best] / odds.sum())


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score.

    A null text, or one without letters, is ``und`` with score 0.  Clashing
    columns are replaced.  Ties go to the first language in code point order.
    The model is bounded, so every worker holds it whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            found = [scorer.predict(t) for t in batch.column(text).to_pylist()]
            arrays = [batch.column(c) for c in own]
            arrays += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*own, "lang_pred", "score"])

    schema = docs.select(*own).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*own).mapInArrow(run, schema)
