"""Wide, long and one-hot forms."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_between
from ..functions.labels import label
from ..session import small_side
from .keys import running_number


def to_long(
    df: DataFrame, ids: Sequence[str], cols: Sequence[str],
    names_to: str = "variable", values_to: str = "value",
) -> DataFrame:
    """One row per id and column; missing values keep their row."""
    return df.unpivot(list(ids), list(cols), names_to, values_to)


def to_wide(
    df: DataFrame, ids: Sequence[str], names_from: str, values_from: str,
    names: Sequence, prefix: str = "", fill=None,
) -> DataFrame:
    """One column per name. ``fill`` goes to absent cells only: a cell whose
    row exists with a missing value stays missing."""
    aggs = []
    for n in names:
        here = F.col(names_from) == F.lit(n)
        cell = F.max(F.when(here, F.col(values_from)))
        if fill is not None:
            seen = F.coalesce(F.max(here.cast("int")), F.lit(0)) == 1
            cell = F.when(seen, cell).otherwise(F.lit(fill))
        aggs.append(cell.alias(f"{prefix}{n}"))
    return df.groupBy(*ids).agg(*aggs)


def levels(df: DataFrame, col: str) -> list:
    """The distinct values of a category, sorted, missing last. They become columns, so
    they come to the driver; give :func:`one_hot` its values to avoid that."""
    found = [r[0] for r in df.select(col).distinct().collect()]
    return sorted([v for v in found if v is not None]) + [v for v in found if v is None]


def one_hot(df: DataFrame, col: str, values: Sequence | None = None) -> DataFrame:
    """0/1 column per level (missing is a level) in place of the category."""
    values = levels(df, col) if values is None else values
    flags = {}
    for v in values:
        name = re.sub(r"[ .]", "_", f"{col}_{'NA' if v is None else v}")
        hit = F.col(col).isNull() if v is None else F.coalesce(F.col(col) == F.lit(v), F.lit(False))
        flags[name] = hit.cast("int")
    return df.withColumns(flags).drop(col)


def number_levels(df: DataFrame, col: str) -> DataFrame:
    """``col``, ``at``: the levels of a category numbered from 0 in sorted order, missing
    last. They are numbered in range-partitioned pieces and never come to the driver."""
    found = df.select(col).distinct()
    order = [F.col(col).isNull(), F.col(col)]
    return running_number(found, [], order, "_rn").select(col, (F.col("_rn") - 1).cast("int").alias("at"))


def one_hot_sparse(df: DataFrame, col: str, to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The category as a sparse vector (``size``, ``indices``, ``values``), for any number of
    levels, and the numbered levels. Missing is a level; other columns stay."""
    levels_of = small_side(number_levels(df, col).select(F.col(col).alias("_level"), "at"))
    size = levels_of.select(F.count(F.lit(1)).cast("int")).scalar()
    vector = F.struct(size.alias("size"), F.array("_at").alias("indices"), F.array(F.lit(1.0)).alias("values"))
    rows = df.join(levels_of.withColumnRenamed("at", "_at"), F.col(col).eqNullSafe(F.col("_level")), "left")
    kept = [c for c in df.columns if c not in (col, to)]
    return rows.select(*kept, vector.alias(to or col)), levels_of.withColumnRenamed("_level", col)


def waves_to_long(
    df: DataFrame, ids: Sequence[str], stem: str, waves: Mapping[int, str],
    wave_name: str = "time", label_name: str = "phase", unknown: str = "Error",
) -> DataFrame:
    """Wide wave columns to long rows, reading the wave out of the name."""
    cols = [f"{stem}_t{w}" for w in waves]
    long = to_long(df, ids, cols, "_name", stem)
    wave = F.regexp_extract("_name", r"_t(\d+)$", 1).try_cast("int")
    return (
        long.withColumn(wave_name, wave)
        .withColumn(label_name, label(F.col(wave_name), dict(waves), other=unknown))
        .drop("_name")
    )


def gap_in_days(
    df: DataFrame, key: str, wave: str, stamp: str, later: int, earlier: int, name: str = "days"
) -> DataFrame:
    """Days between two waves, one row per subject."""
    wide = to_wide(df.where(F.col(wave).isin(later, earlier)), [key], wave, stamp,
                   [earlier, later], prefix="_w")
    return wide.select(key, days_between(f"_w{later}", f"_w{earlier}").alias(name))


def union_tagged(tables: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Union by name with the table's name in a column."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
