"""Quality rules whose thresholds follow the data, per language and source.

Counts over whole texts are turned into whole-number rates.  Per language,
source and rate, a histogram with buckets of bounded relative width is the
quantile sketch: two sketches merge by adding counts, so partial aggregation
builds it, and a group with few documents uses the sketch merged over its
language or over everything.  A rate beyond the far-out fence of its sketch
(quartile plus or minus ``FENCE`` quartile distances) rejects the document.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectlake.llm.staging import free

#: Quartile distances between a quartile and its fence.
FENCE = 3
#: Documents a sketch needs before its quartiles are trusted.
ENOUGH = 200
#: rate: (numerator, factor, denominator, smallest quartile distance, low side too)
RATES = {
    "word_length": ("word_chars", 100, "n_words", 60, True),
    "symbols": ("n_symbols", 1000, "n_words", 60, False),
    "dup_lines": ("n_dup_lines", 1000, "n_lines", 100, False),
    "repeats": ("n_repeat_words", 1000, "n_words", 80, False),
}
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
#: Buckets are exact below 2**BITS and have BITS leading bits above.
BITS = 6

_SPACE = r"[\\x20\\x09-\\x0D]"


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    A null or empty text has zeros.  Columns of these names in ``docs`` are
    replaced; all others are kept.  Windows are compared by 64-bit hashes of
    eight word hashes within one text.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    own = docs.select(*(c for c in docs.columns if c.lower() not in made or c == text))
    t, w, h, g, s, p, ls = free("t_", "w_", "h_", "g_", "s_", "p_", "l_", among=own.columns)
    at = ", ".join(f"{h}[i + {k}]" for k in range(WINDOW))
    last = f"size({s}) - 1"
    return (
        own.withColumn(t, F.coalesce(F.col(text), F.lit("")))
        .withColumn(w, F.expr(f"filter(split({t}, '{_SPACE}+'), x -> x != '')"))
        .withColumn(h, F.expr(f"transform({w}, x -> xxhash64(x))"))
        .withColumn(ls, F.expr(f"filter(split({t}, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
        .select(
            *own.columns,
            F.expr(f"cast(size({h}) as long)").alias("n_words"),
            F.expr(f"cast(length(regexp_replace({t}, '{_SPACE}+', '')) as long)").alias("word_chars"),
            F.expr(f"cast(length({t}) - length(translate({t}, '#*$%&|<>', '')) as long)").alias("n_symbols"),
            F.expr(f"cast(size({ls}) as long)").alias("n_lines"),
            F.expr(f"cast(size({ls}) - size(array_distinct({ls})) as long)").alias("n_dup_lines"),
            F.expr(
                f"if(size({h}) < {WINDOW}, array(), transform(sequence(0, size({h}) - {WINDOW}), i -> xxhash64({at})))"
            ).alias(g),
        )
        .withColumn(
            s,
            F.expr(
                f"if(size(array_distinct({g})) = size({g}), null, "
                f"array_sort(transform({g}, (x, i) -> struct(x as x, i as i))))"
            ),
        )
        .withColumn(
            p,
            F.expr(
                f"array_sort(transform(filter(sequence(0, {last}), j -> "
                f"(j > 0 and {s}[greatest(j - 1, 0)].x = {s}[j].x) "
                f"or (j < {last} and {s}[least(j + 1, {last})].x = {s}[j].x)), j -> {s}[j].i))"
            ),
        )
        .select(
            *own.columns,
            *made[:-1],
            F.expr(
                f"if({p} is null, 0L, {WINDOW}L + aggregate(zip_with(slice({p}, 2, size({p})), "
                f"slice({p}, 1, size({p}) - 1), (b, a) -> least({WINDOW}, b - a)), 0L, (x, y) -> x + y))"
            ).alias("n_repeat_words"),
        )
    )


def base_failed() -> str:
    return f"(n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)"


def _rate(name: str) -> str:
    over, factor, under, _, _ = RATES[name]
    return f"if({under} = 0, 0L, ({factor} * {over}) div {under})"


def sketches(measured: DataFrame) -> DataFrame:
    """Mergeable sketches (lang, source, rate, bucket, n) of documents that pass the base rules."""
    rates = ", ".join(f"struct('{name}' as rate, {_rate(name)} as v)" for name in RATES)
    shift = f"greatest(0, length(bin(v)) - {BITS})"
    return (
        measured.filter(f"not {base_failed()}")
        .selectExpr("lang", "source", f"inline(array({rates}))")
        .selectExpr("lang", "source", "rate", f"shiftleft(shiftright(v, {shift}), {shift}) as bucket")
        .groupBy("lang", "source", "rate", "bucket")
        .agg(F.count("*").alias("n"))
    )


def thresholds(measured: DataFrame) -> DataFrame:
    """One row for each language and source: ``low_<rate>`` and ``high_<rate>``.

    Sketches are merged along grouping sets; each group takes the narrowest of
    (language and source), language, everything that counts ``ENOUGH``
    documents, and everything failing that.  Languages and sources may be null.
    """
    counts = sketches(measured)
    levels = {"own": ["lang", "source"], "tongue": ["lang"], "all": []}
    out = counts.select("lang", "source", "rate").distinct()
    for level, keys in levels.items():
        by = [*keys, "rate"]
        merged = counts.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
        part = ", ".join(by)
        ranked = merged.selectExpr(
            *by, "bucket", f"sum(n) over (partition by {part}) as total",
            f"sum(n) over (partition by {part} order by bucket rows between unbounded preceding and current row) as upto",
        )
        quartiles = ranked.groupBy(*by).agg(
            F.max("total").alias("total"),
            F.expr("min(bucket) filter (where 4 * upto >= total)").alias("q1"),
            F.expr("min(bucket) filter (where 4 * upto >= 3 * total)").alias("q3"),
        )
        side = quartiles.select(
            *(F.col(k).alias(f"{level}_{k}") for k in by), F.struct("total", "q1", "q3").alias(level)
        )
        same = [F.col(k).eqNullSafe(F.col(f"{level}_{k}")) for k in by]
        out = out.join(side, same, "left").drop(*(f"{level}_{k}" for k in by))
    chosen = out.selectExpr(
        "lang", "source", "rate",
        f"case when own.total >= {ENOUGH} then own when tongue.total >= {ENOUGH} then tongue else all end as q",
    )
    limits = []
    for name, (_, _, _, least, both) in RATES.items():
        reach = f"{FENCE} * greatest(q.q3 - q.q1, {least})"
        low = f"q.q1 - {reach}" if both else "-1L"
        limits.append(F.expr(f"max({low}) filter (where rate = '{name}')").alias(f"low_{name}"))
        limits.append(F.expr(f"max(q.q3 + {reach}) filter (where rate = '{name}')").alias(f"high_{name}"))
    return chosen.groupBy("lang", "source").agg(*limits)


def judge(measured: DataFrame) -> DataFrame:
    """Add base_failed and kept (boolean) to documents with ``features``.

    Null counts do not occur after ``features``; a null language or source is a
    group of its own.  ``measured`` is read twice, so pass a staged table.
    """
    limits = thresholds(measured).withColumnsRenamed({"lang": "limit_lang", "source": "limit_source"})
    own = [c for c in measured.columns if c not in ("base_failed", "kept")]
    same = [F.col("lang").eqNullSafe(F.col("limit_lang")), F.col("source").eqNullSafe(F.col("limit_source"))]
    inside = " and ".join(f"{_rate(n)} between low_{n} and high_{n}" for n in RATES)
    return (
        measured.select(*own)
        .join(limits, same, "left")
        .selectExpr(
            *own, f"{base_failed()} as base_failed", f"not {base_failed()} and coalesce({inside}, true) as kept"
        )
    )
