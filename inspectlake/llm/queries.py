"""The dealt operators over their whole tables, as registered queries."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

import corpus_pipeline
from inspectlake.llm import (
    contextmix,
    conversations,
    extraction,
    languages,
    mixing,
    neardup,
    negatives,
    neighbours,
    oracles,
    packing,
    quality,
    repeats,
    resharding,
    secrets,
)
from inspectlake.llm.staging import stage, table
from inspectlake.llm.words import count_words


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.expr(count_words()).alias("size"))
    mixed, quotas = mixing.mix_table(docs, "size")
    quotas = quotas.withColumnRenamed("source", "of")
    return mixed.join(quotas, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("mix_sources")).alias("taken")
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.features(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    measured = stage(measured.drop("text"), "quality")
    return quality.judge(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, true)"


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = languages.fit(docs.filter(f"not {HELD_OUT}"))
    return languages.predict(docs.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "text"), model).drop("text")


def op4_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout: one of eight shards by a hash of the source, so sizes differ widely."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.expr("cast(crc32(cast(coalesce(source, '') as binary)) % 8 as int)").alias("old_shard"),
    )
    placed = resharding.reshard(docs, "old_shard", "size", 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as lengths; equal texts are a duplicate cluster."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.expr(count_words()).alias("size"), F.md5("text").alias("cluster")
    )
    return packing.pack(docs, "size", "source", "cluster")


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_strings(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes",
        F.expr("aggregate(removed, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), "kept_sha256",
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extraction.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    line = "concat_ws(',', transform({}, s -> concat_ws(':', s.kind, s.start, s.end)))"
    base = "filter(secrets, s -> s.layer = 0)"
    return found.select(
        "doc_id",
        *(
            F.expr(f"cast(size(filter(secrets, s -> s.layer = 0 and s.kind = '{k}')) as long)").alias(f"n_{k}")
            for k in secrets.KINDS
        ),
        F.expr(f"sha2({line.format(base)}, 256)").alias("base_sha256"),
        F.expr(line.format("secrets")).alias("spans"),
    )


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "vec_id % 20 = 0")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of ``conversations`` damaged by a hash of their names; ``gone`` marks dropped ones."""
    named = "concat(coalesce(cast(conv_id as string), ' '), ':', coalesce(cast(turn as string), ' '))"
    rows = turns.select("conv_id", "turn", "role", "text", F.expr(f"crc32(cast({named} as binary)) % 20").alias("damage"))
    return rows.select(
        "conv_id", "turn",
        F.expr("if(damage = 4, 'user', coalesce(role, ' '))").alias("role"),
        F.expr("case damage when 1 then '' when 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '') else coalesce(text, ' ') end").alias("text"),
        F.expr("damage = 0").alias("gone"),
        F.explode(F.expr("array_repeat(0, if(damage = 3, 2, 1))")).alias("copy"),
    ).drop("copy")


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, sha: SHA-256 of the newline-joined ``role:text`` of each conversation, streamed in the order of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, now, out = None, None, []
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    digest, now = hashlib.sha256(), conv
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([s for _, s in out], pa.string())], names=["conv", "sha"])
            out.clear()
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()], pa.string())], names=["conv", "sha"])

    kind = to_arrow_type(rows.schema["conv_id"].dataType)
    return rows.select("conv_id", "role", "text").mapInArrow(run, StructType([StructField("conv", rows.schema["conv_id"].dataType)]).add("sha", "string"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, what is wrong with them and their cheapest repair."""
    rows = damaged(table(spark, sf_dir, "conversations"))
    found = stage(conversations.report(rows, "gone"), "report")
    sums = digests(conversations.repaired(rows, found.select("conv_id", "audit"), "gone"))
    return found.join(sums, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh vector are moved on; components are integers of 1/256."""
    finite = "forall(embedding, x -> x is not null and abs(double(x)) < double('infinity'))"
    items = table(spark, sf_dir, "embeddings").filter(f"label is not null and embedding is not null and {finite}")
    items = items.selectExpr(
        "vec_id", "if(vec_id % 7 = 0, (label + 1) % 10, label) as label", "transform(embedding, x -> floor(256D * double(x))) as v"
    )
    return negatives.mine(items, "vec_id % 100 = 0")


UNSEEN = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 7 = 2, true)"


def op13_context_mix_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text under the context mix and under single words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(UNSEEN).alias("held_out"), "text")
    return contextmix.score(docs, "not held_out", ["doc_id", "held_out"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", (F.col("bits") * -math.log10(2)).alias("score"), "bits_per_byte"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_mix_sources, op2_quality_rules, op3_language_id, op4_reshard, op5_near_duplicates, op6_best_fit_packing, op7_repeated_strings, op8_html_extraction, op9_secret_scan, op10_nearest_neighbours, op11_conversation_repair, op12_hard_negatives, op13_context_mix_scores)
    return {query.__name__: query for query in made} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    own = oracles.oracle_sql()
    return own | {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else own
