"""Correlation tests, matrices and the factor screen."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dist import NORMAL_975, p_of_t
from .moments import as_matrix, centred, cross_products, pairwise_correlations


def finish_test(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """Add t, df, p and the Fisher-z interval to correlations with counts."""
    rr, nn = F.col(r), F.col(n)
    z, half = F.atanh(rr), F.lit(NORMAL_975) / F.sqrt(nn - 3)
    out = df.withColumns({
        "df": (nn - 2).cast("double"),
        "t": F.try_divide(rr * F.sqrt(nn - 2), F.sqrt(1 - rr * rr)),
        "lo": F.when(nn > 3, F.tanh(z - half)),
        "hi": F.when(nn > 3, F.tanh(z + half)),
    })
    return out.withColumn("p", p_of_t("t", "df"))


def correlation_test(
    df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()
) -> DataFrame:
    """Pearson test of each column pair, optionally per group."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"),
                 F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
        for a, b in pairs
    ]))
    long = df.select(*by, rows.alias("v")).select(*by, "v.*").where("a IS NOT NULL AND b IS NOT NULL")
    out = long.groupBy("x", "y", *by).agg(F.corr("a", "b").alias("r"), F.count(F.lit(1)).alias("n"))
    return finish_test(out)


def slope_correlation(
    df: DataFrame, moderators: Sequence[str], later: str, earlier: str, by: Sequence[str] = ()
) -> DataFrame:
    """Correlation of a change with each moderator."""
    changed = df.withColumn("slope", F.col(later) - F.col(earlier))
    return correlation_test(changed, [(m, "slope") for m in moderators], by)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlations, one row per column pair."""
    return pairwise_correlations(df, cols)


def network_edges(df: DataFrame, cols: Sequence[str], threshold: float = 0.3) -> DataFrame:
    """Correlations strong enough to be drawn as edges."""
    return correlation_matrix(df, cols).where(F.abs("r") >= threshold)


def factor_screen(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Eigenvalues of the complete-case correlation matrix with the rules used
    to choose a number of factors: eigenvalue over one, and the largest bend
    (second difference) of the scree line. Constant columns have no correlations and
    are left out; the last rows then have no figures."""
    k = len(cols)
    sums = cross_products(df, cols).withColumn("_all", F.lit(0))

    def screen(rows: pd.DataFrame) -> pd.DataFrame:
        _, _, c = centred(as_matrix(rows, k))
        sd = np.sqrt(np.diag(c))
        varies = np.flatnonzero(sd > 0)
        own = len(varies)
        values, bend = np.full(k, np.nan), np.full(k, np.nan)
        if own:
            values[:own] = np.linalg.eigvalsh(c[np.ix_(varies, varies)] / np.outer(sd[varies], sd[varies]))[::-1]
        bend[1:-1] = values[2:] - 2 * values[1:-1] + values[:-2]
        elbow = int(np.nanargmax(bend)) if own > 2 else 0
        return pd.DataFrame({
            "k": np.arange(1, k + 1, dtype="int32"),
            "eigenvalue": values,
            "share": values / max(own, 1),
            "acceleration": bend,
            "over_one": values > 1,
            "before_elbow": np.arange(k) < elbow,
        })

    schema = (
        "k int, eigenvalue double, share double, acceleration double, "
        "over_one boolean, before_elbow boolean"
    )
    return sums.groupBy("_all").applyInPandas(screen, schema).withColumns(
        {c: F.nanvl(c, F.lit(None)) for c in ("eigenvalue", "share", "acceleration")}
    )
