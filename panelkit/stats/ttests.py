"""t tests from group counts, means and variances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import GRADED_STARS, stars
from ..operators.reshape import to_long
from .dist import NORMAL_975, p_of_t


def _d_interval(d: Column, var: Column) -> dict[str, Column]:
    """Large-sample interval of an effect size."""
    half = F.lit(NORMAL_975) * F.sqrt(var)
    return {"d_lo": d - half, "d_hi": d + half}


def two_sample(
    df: DataFrame, cols: Sequence[str], group: str, marks=GRADED_STARS
) -> DataFrame:
    """Pooled-variance t test of each variable between the true and the false
    rows of ``group``."""
    side = to_long(
        df.select(group, *[F.col(c).cast("double").alias(c) for c in cols]), [group], cols
    ).where(F.col(group).isNotNull())
    parts = side.groupBy("variable").agg(
        *[
            f(F.when(F.col(group) == v, F.col("value"))).alias(f"{name}{tag}")
            for v, tag in ((True, "1"), (False, "0"))
            for f, name in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))
        ]
    )
    n1, n0 = F.col("n1"), F.col("n0")
    out = parts.withColumn("df", (n1 + n0 - 2).cast("double"))
    pooled = ((n1 - 1) * F.col("v1") + (n0 - 1) * F.col("v0")) / F.col("df")
    out = out.withColumn("sd", F.sqrt(pooled)).withColumn(
        "t", F.try_divide(F.col("m1") - F.col("m0"), F.col("sd") * F.sqrt(1 / n1 + 1 / n0))
    )
    out = out.withColumn("d", F.try_divide(F.col("m1") - F.col("m0"), F.col("sd")))
    var_d = 1 / n1 + 1 / n0 + F.col("d") * F.col("d") / (2 * (n1 + n0))
    out = out.withColumns(_d_interval(F.col("d"), var_d)).withColumn("p", p_of_t("t", "df"))
    return out.withColumn("sig", stars("p", marks))


def one_sample(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """t test of each variable's mean against zero."""
    long = to_long(df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]), by, cols)
    out = long.groupBy("variable", *by).agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd")
    )
    n = F.col("n")
    out = out.withColumns({
        "t": F.try_divide(F.col("m"), F.col("sd") / F.sqrt(n)),
        "df": (n - 1).cast("double"),
        "d": F.try_divide(F.col("m"), F.col("sd")),
    })
    var_d = 1 / n + F.col("d") * F.col("d") / (2 * n)
    return out.withColumns(_d_interval(F.col("d"), var_d)).withColumn("p", p_of_t("t", "df"))


def paired(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """t test of the difference of each column pair (first minus second)."""
    named = {f"{a} - {b}": F.col(a) - F.col(b) for a, b in pairs}
    diffs = df.select(*by, *[e.alias(n) for n, e in named.items()])
    return one_sample(diffs, list(named), by)
