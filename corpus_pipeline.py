"""From raw documents to packed training bins, stage by stage.

Each stage takes all rows its predecessor kept and, but for the last, returns
the columns of ``documents``.  ``run`` writes every result as Parquet in the
shared folder and rereads it, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectlake.llm import languages, mixing, neardup, packing, secrets
from inspectlake.llm.staging import free, stage
from inspectlake.llm.words import count_words

#: Documents whose language is less certain than this are rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents, drop what has no recognizable language, fill missing labels."""
    found = languages.predict(docs, languages.fit(docs))
    kept = found.filter((F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    Rows of one doc_id are one document; rows without doc_id are not judged and stay.
    """
    kept = neardup.near_duplicates(docs, k=5, percent=80).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    one = docs.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.filter("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret, of any decoded layer, by a mark; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once, twice or not at all."""
    (size,) = free("size", among=docs.columns)
    mixed, _ = mixing.mix_table(docs.withColumn(size, F.expr(count_words())), size)
    return mixing.repeat(mixed).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of words; a bin holds no two pieces of one source or of one text."""
    measured = docs.select("doc_id", "source", F.expr(count_words()).alias("size"), F.md5("text").alias("cluster"))
    return packing.pack(measured, "size", "source", "cluster")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Language models, sketches and bin search have no SQL form; tests check against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
