"""Written intermediate tables and free column names.

Intermediate results are Parquet tables in the folder that all executors
share, so a lost executor costs the tasks it ran and nothing behind them.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectlake.session import shared_dir


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; this cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _sweep(spark)
    df.write.option("compression", "zstd").parquet(path)
    time.sleep(1.5)
    _sweep(spark)
    return spark.read.schema(df.schema).parquet(path)


def _sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files that no plan refers to any more.

    It learns of them when the driver collects garbage, which a small driver
    heap would leave for long; the next step needs the disk now.  A finished
    write is let go of shortly after its end, hence the pause before.
    """
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Remove the staged table behind ``df`` once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free(*names: str, among: list[str]) -> list[str]:
    """The names, with underscores put before those that ``among`` has taken."""
    taken, out = {x.lower() for x in among}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
