"""The numbers behind each figure."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import attach_stats
from .quantiles import quantiles


def histogram(df: DataFrame, value: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts in bins centred on multiples of the width."""
    bin_no = F.floor((F.col(value) + F.lit(width / 2)) / F.lit(width))
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, (bin_no * F.lit(width)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def density_histogram(df: DataFrame, value: str, width: float, by: Sequence[str]) -> DataFrame:
    """Histogram scaled to unit area inside each group."""
    bars = histogram(df, value, width, by)
    totals = bars.groupBy(*by).agg(F.sum("n").alias("_total"))
    return attach_stats(bars, totals, by).withColumn(
        "density", F.col("n") / (F.col("_total") * F.lit(width))
    ).drop("_total")


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whisker ends within 1.5 IQR and outlier count per group."""
    q = quantiles(df, value, [0.25, 0.5, 0.75], by).select(
        *by, F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75")
    )
    x = F.col(value)
    iqr = F.col("q75") - F.col("q25")
    inside = (x >= F.col("q25") - 1.5 * iqr) & (x <= F.col("q75") + 1.5 * iqr)
    return (
        attach_stats(df.select(*by, value), q, by)
        .groupBy(*by, "q25", "median", "q75")
        .agg(
            F.min(F.when(inside, x)).alias("lower"),
            F.max(F.when(inside, x)).alias("upper"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


# Bins per bandwidth, and bandwidths after which the kernel counts as 0.
BINS_PER_BANDWIDTH, REACH = 16, 8


def density_curve(df: DataFrame, value: str, by: Sequence[str], points: int = 64) -> DataFrame:
    """Gaussian kernel density on an even grid over each group's range.

    Bandwidth: 0.9 s n^(-1/5), s being min(SD, IQR / 1.34), or where that is 0 the SD,
    or else the size of the least value, or else 1; so constant groups have a curve. Rows
    are first counted in bins of a sixteenth of the bandwidth, which stand at the mean of
    their rows, and a bin meets only the grid points within reach of its kernel.
    """
    x = F.nanvl(F.col(value).cast("double"), F.lit(None))
    rows = df.select(*by, x.alias("_x")).where((F.abs("_x") < float("inf")))
    q = quantiles(rows, "_x", [0.25, 0.75], by).select(*by, (F.col("q")[1] - F.col("q")[0]).alias("_iqr"))
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_sd"),
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
    )
    positive = lambda c: F.when(c > 0, c)
    spread = F.coalesce(
        positive(F.least(F.col("_sd"), F.col("_iqr") / 1.34)), positive(F.col("_sd")), positive(F.abs("_lo")), F.lit(1.0))
    stats = attach_stats(stats, q, by).withColumn(
        "_bw", F.lit(0.9) * spread * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    step = F.col("_bw") / BINS_PER_BANDWIDTH
    counted = (
        attach_stats(rows, stats, by).where("_n IS NOT NULL")
        .groupBy(*by, "_n", "_lo", "_hi", "_bw", F.floor((F.col("_x") - F.col("_lo")) / step).alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_w"), F.avg("_x").alias("_c"))
    )
    gap = (F.col("_hi") - F.col("_lo")) / F.lit(float(points - 1))
    point = F.col("_lo") + F.col("_k") * gap
    centre = F.col("_c") - F.col("_lo")
    reach = REACH * F.col("_bw")
    # Without a range all points are the same one.
    first = F.when(gap > 0, F.ceil((centre - reach) / gap)).otherwise(0)
    last = F.when(gap > 0, F.floor((centre + reach) / gap)).otherwise(points - 1)
    first, last = F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(points - 1)).cast("int")
    met = F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))).alias("_k")
    u = (point - F.col("_lo") - centre) / F.col("_bw")
    kernel = F.exp(-u * u / 2) / F.lit(math.sqrt(2 * math.pi))
    heights = counted.select("*", met).groupBy(*by, "_k").agg(
        F.sum(F.col("_w") * kernel / (F.col("_n") * F.col("_bw"))).alias("_density"))
    grid = stats.select(*by, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_k"))
    return attach_stats(grid, heights, [*by, "_k"]).select(
        *by, F.col("_k").alias("point"), point.alias("x"), F.coalesce("_density", F.lit(0.0)).alias("density"))
