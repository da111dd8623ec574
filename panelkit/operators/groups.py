"""Grouped summaries, standardisation and group splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import ColumnLike, as_col
from .joins import attach_stats, constant
from .quantiles import median as exact_median
from .quantiles import quantiles
from .reshape import to_long

CI_FACTOR = 1.96


def std_error(c: ColumnLike, skip_missing: bool = True) -> Column:
    """Standard error of the mean; divides by all rows if not skipping."""
    c = as_col(c)
    n = F.count(c) if skip_missing else F.count(F.lit(1))
    return F.try_divide(F.stddev_samp(c), F.sqrt(n))


def share(cond: Column) -> Column:
    """Share of rows meeting a condition, among rows where it is known."""
    return F.avg(cond.cast("double"))


def mean_sd(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_m"), F.stddev_samp(c).alias(f"{c}_sd")]
    return df.groupBy(*by).agg(*aggs)


def ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Two rows, the minimum and the maximum of every column."""
    low = df.agg(*[F.min(c).alias(f"{c}_1") for c in cols], *[F.max(c).alias(f"{c}_2") for c in cols])
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("bound"), *[F.col(f"{c}_{k}").alias(c) for c in cols])
        for k, name in ((1, "min"), (2, "max"))
    ]))
    return low.select(rows.alias("r")).select("r.*")


def group_counts(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def present_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count(c).alias(c) for c in cols])


def frequency(df: DataFrame, col: str, with_missing: bool = False) -> DataFrame:
    rows = df if with_missing else df.where(F.col(col).isNotNull())
    return group_counts(rows, col)


def group_means(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])


def six_numbers(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Min, quartiles, mean, max and missing count per variable and group."""
    long = to_long(df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]), by, cols)
    keys = ["variable", *by]
    plain = long.groupBy(*keys).agg(
        F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
    )
    q = quantiles(long, "value", [0.25, 0.5, 0.75], keys).select(
        *keys, F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75")
    )
    return attach_stats(plain, q, keys)


def time_summary(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Min, mean, median and max of a timestamp, as seconds since 1970."""
    seconds = (F.unix_micros(F.col(col).cast("timestamp")) / F.lit(1e6)).alias("_s")
    s = df.select(*by, seconds)
    plain = s.groupBy(*by).agg(F.min("_s").alias("min"), F.avg("_s").alias("mean"), F.max("_s").alias("max"))
    md = exact_median(s, "_s", by, "median")
    return attach_stats(plain, md, by) if by else plain.withColumn("median", constant(md, "median"))


def cell_means(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean, standard error and interval of each cell."""
    return (
        df.groupBy(*by)
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), std_error(value).alias("se"))
        .withColumn("lo", F.col("mean") - CI_FACTOR * F.col("se"))
        .withColumn("hi", F.col("mean") + CI_FACTOR * F.col("se"))
    )


def long_summary(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, SD, min and max per variable and group."""
    return to_long(df, by, cols).groupBy("variable", *by).agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )


# Fractions of the SD shown next to each variable.
SD_FRACTIONS = {"sd_2_3": 2 / 3, "sd_055": 0.55, "sd_1_2": 1 / 2, "sd_1_3": 1 / 3, "sd_1_4": 1 / 4}


def sd_grid(
    df: DataFrame, cols: Sequence[str], by: Sequence[str], floored: bool = False
) -> DataFrame:
    out = to_long(df, by, cols).groupBy("variable", *by).agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("sd")
    )
    out = out.withColumns({n: F.col("sd") * F.lit(f) for n, f in SD_FRACTIONS.items()})
    if floored:
        out = out.withColumns({c: F.floor(c).cast("bigint") for c in ("sd", *SD_FRACTIONS)})
    return out


def parent_share(df: DataFrame, cell: Sequence[str], parent: Sequence[str]) -> DataFrame:
    """Row count of each cell and its share of the parent group."""
    cells = group_counts(df, *cell)
    parents = cells.groupBy(*parent).agg(F.sum("n").alias("n_group"))
    return attach_stats(cells, parents, parent).withColumn("gsize", F.col("n") / F.col("n_group"))


def zscore(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), suffix: str = "_z") -> DataFrame:
    """Standardise against the table or, with ``by``, inside each group."""
    if by:
        with_stats = attach_stats(df, mean_sd(df, cols, by), by)
        z = {c + suffix: F.try_divide(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_sd")) for c in cols}
        out = with_stats.withColumns(z)
        return out.drop(*[f"{c}{s}" for c in cols for s in ("_m", "_sd")])
    return zscore_against(df, df, cols, suffix)


def zscore_against(
    df: DataFrame, baseline: DataFrame, cols: Sequence[str], suffix: str = "_z"
) -> DataFrame:
    """Standardise against the mean and SD of another population."""
    stats = mean_sd(baseline, cols)
    return df.withColumns({
        c + suffix: F.try_divide(F.col(c) - constant(stats, f"{c}_m"), constant(stats, f"{c}_sd"))
        for c in cols
    })


def median_split(
    df: DataFrame, col: str, by: Sequence[str] = (), name: str | None = None,
    high: str = "high", low: str = "low", per: str = "row", subject: str | None = None,
) -> DataFrame:
    """Above the median is high; ties are low; missing stays missing.

    ``per="subject"`` takes the median over one row per subject instead of
    over all rows of a long table.
    """
    base = df
    if per == "subject":
        base = df.groupBy(*by, subject).agg(F.max(col).alias(col))
    m = exact_median(base, col, by, "_median")
    cut_at = F.col("_median") if by else constant(m, "_median")
    with_m = attach_stats(df, m, by) if by else df
    split = F.when(F.col(col) > cut_at, high).when(F.col(col) <= cut_at, low)
    return with_m.withColumn(name or f"{col}_group", split).drop("_median")


def at_extreme(df: DataFrame, col: str, by: Sequence[str] = (), largest: bool = False) -> DataFrame:
    """Rows at the minimum (or maximum) of each group, ties kept."""
    best = (F.max if largest else F.min)(col).alias("_best")
    if by:
        kept = attach_stats(df, df.groupBy(*by).agg(best), by).where(F.col(col) == F.col("_best"))
        return kept.drop("_best")
    return df.where(F.col(col) == constant(df.agg(best), "_best"))


def above_minimum(df: DataFrame, col: str, by: Sequence[str], name: str) -> DataFrame:
    """Distance of a value to the smallest of its group."""
    least = df.groupBy(*by).agg(F.min(col).alias("_least"))
    return attach_stats(df, least, by).withColumn(name, F.col(col) - F.col("_least")).drop("_least")


def two_level_mean(df: DataFrame, value: str, subject: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean over subjects of each subject's own mean."""
    return (
        df.groupBy(*subject).agg(F.avg(value).alias(value))
        .groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias(value))
    )


def norm_z(df: DataFrame, col: str, norm_mean: float, norm_sd: float) -> DataFrame:
    """Sample mean against a published norm, in SD units of the norm."""
    return df.agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("sd")).withColumn(
        "z", (F.col("m") - F.lit(norm_mean)) / F.lit(norm_sd)
    )


def rescaled_mean_sd(df: DataFrame, col: str, factor: float) -> DataFrame:
    """Mean and SD after turning a mean-item score into a sum score."""
    x = F.col(col) * F.lit(factor)
    return df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("sd"))


def ordered(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """Sort on several keys, each "asc" or "desc", missing values last."""
    return df.orderBy(*[
        F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last()
        for c, d in spec.items()
    ])
