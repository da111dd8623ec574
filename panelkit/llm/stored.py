"""Small results written to the shared folder and read back."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# Whether Spark drops the shuffle files of a query at its end.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str = "part", by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``df`` from a table in the shared folder, in folders ``by`` columns.
    Unlike a checkpoint it brings no inferred constraints along, which loops would pile up.
    The shuffle files of the write go with it: a collection of garbage does not drop those of
    the step that has just ended."""
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now, not at some later
    collection of garbage: it removes what neither Python nor the driver refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """A stored table of short rows, marked for broadcast if it was counted to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
