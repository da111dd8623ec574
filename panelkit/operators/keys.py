"""Duplicate keys, first row per key, key sets, running numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# A window may sort a group of this many rows in one task; larger groups are
# numbered in range-partitioned pieces.
WINDOW_GROUP_ROWS = 2_000_000


def duplicated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1").drop("count")


def single_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count = 1").drop("count")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key under an explicit order.

    The rank filter is pushed below the shuffle by Spark (window group limit),
    so a hot key sends at most one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def flag_members(df: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    """True where the key is in ``members``; never NULL."""
    marks = members.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(marks, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def running_number(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str = "rn",
    window_rows: int = WINDOW_GROUP_ROWS,
) -> DataFrame:
    """Number rows inside each group, from 1.

    ``order`` must be total inside a group. Groups proven small go through one
    window. Otherwise rows are range-partitioned on (group, order), so a hot
    group spreads over tasks; each piece is numbered on its own and shifted by
    the row counts of the pieces before it.
    """
    largest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest <= window_rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    ranged = cut(df.repartitionByRange(*by, *order).withColumn("_piece", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "_piece").count()
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(b).alias(f"_o_{b}") for b in by],
        F.col("_piece").alias("_o_piece"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"),
    )
    same = F.col("_piece") == F.col("_o_piece")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_o_{b}"))
    inside = Window.partitionBy(*by, "_piece").orderBy(*order)
    return (
        ranged.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, same, "inner")
        .withColumn(name, (F.col("_inside") + F.col("_offset")).cast("bigint"))
        .select(*df.columns, name)
    )
