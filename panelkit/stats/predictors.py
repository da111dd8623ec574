"""Choosing predictors of change: elastic-net path, ranking, nested models.

The data are read once into moments. The solvers then work on k x k numbers,
one task per target.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .corr import finish_test
from .dist import f_tail
from .moments import as_matrix, centred, cross_products

# Mixing of the two penalties and length of the path.
ALPHA = 0.5
PATH_LENGTH = 2000
# The path ends when explained deviance stops growing by this
# share, or is this high; smallest penalty relative to the largest.
LEAST_GAIN = 1e-5
HIGHEST_DEVIANCE = 0.999
PENALTY_RANGE = 1e-4


def train_flag(key: str | Column, parts: int = 4, train_parts: int = 3) -> Column:
    """Seed-free split by a hash of the key: the same rows train on any
    cluster and any partitioning."""
    key = F.col(key) if isinstance(key, str) else key
    bucket = F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(parts))
    return bucket < train_parts


def target_moments(
    df: DataFrame, predictors: Sequence[str], targets: Sequence[str]
) -> DataFrame:
    """Moments of the complete rows, repeated per target with the target last."""
    p = len(predictors)
    sums = cross_products(df, [*predictors, *targets])
    numbered = F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.lit(p + 1 + i).alias("at")) for i, t in enumerate(targets)
    ])).alias("t")
    mine = lambda c: (F.col(c) <= p) | (F.col(c) == F.col("t.at"))
    place = lambda c: F.when(F.col(c) <= p, F.col(c)).otherwise(F.lit(p + 1))
    return sums.select("*", numbered).where(mine("i") & mine("j")).select(
        F.col("t.target").alias("target"), place("i").alias("i"), place("j").alias("j"), "s"
    )


# Beyond this many sweeps over the predictors the path counts as failed.
MOST_SWEEPS = 100_000


def solve_path(
    r: np.ndarray, corr: np.ndarray, n: float, alpha: float, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients on the standardised scale along a falling penalty."""
    p = len(r)
    top = np.max(np.abs(r)) / alpha
    floor = PENALTY_RANGE if n > p else 0.01
    penalties = top * floor ** (np.arange(length) / (length - 1))
    beta, path, explained = np.zeros(p), [], 0.0
    fit = np.zeros(p)  # corr @ beta
    for step, lam in enumerate(penalties):
        for _ in range(MOST_SWEEPS):
            moved = 0.0
            for j in range(p):
                pull = r[j] - fit[j] + beta[j]
                new = np.sign(pull) * max(abs(pull) - lam * alpha, 0.0) / (1.0 + lam * (1 - alpha))
                change = new - beta[j]
                if change:
                    beta[j] = new
                    fit += corr[:, j] * change
                    moved = max(moved, change * change)
            if moved < 1e-14:
                break
        else:
            raise ArithmeticError("the coefficients did not settle")
        path.append(beta.copy())
        now = 2 * r @ beta - beta @ fit
        stalled = step >= 5 and now - explained < LEAST_GAIN * now
        if stalled or now > HIGHEST_DEVIANCE:
            break
        explained = now
    return penalties[: len(path)], np.array(path)


def elastic_net_path(
    df: DataFrame, predictors: Sequence[str], targets: Sequence[str],
    alpha: float = ALPHA, length: int = PATH_LENGTH,
) -> DataFrame:
    """Coefficient of every predictor at every step, per target, on the scale
    of the data (rows: target, step, lambda, predictor, beta)."""
    names = list(predictors)
    p = len(names)

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, _, c = centred(as_matrix(rows, p + 1))
        sd = np.sqrt(np.diag(c) / n)
        scale = np.where(sd > 0, sd, 1.0)
        corr = c / n / np.outer(scale, scale)
        lam, path = solve_path(corr[:p, p], corr[:p, :p], n, alpha, length)
        back = path * scale[p] / scale[:p]
        steps = len(lam)
        return pd.DataFrame({
            "target": key[0],
            "step": np.repeat(np.arange(1, steps + 1, dtype="int32"), p),
            "lambda": np.repeat(lam * scale[p], p),
            "predictor": np.tile(names, steps),
            "beta": back.ravel(),
        })

    schema = "target string, step int, lambda double, predictor string, beta double"
    return target_moments(df, names, targets).groupBy("target").applyInPandas(solve, schema)


def rank_predictors(path: DataFrame) -> DataFrame:
    """Predictors by the number of steps they stay in the model."""
    kept = path.groupBy("target", "predictor").agg(F.count_if(F.col("beta") != 0).alias("persistence"))
    return number_ranked(kept)


def number_ranked(kept: DataFrame) -> DataFrame:
    """Number the predictors of a target, most persistent first, then by name."""
    w = Window.partitionBy("target").orderBy(F.desc("persistence"), "predictor")
    return kept.withColumn("row", F.row_number().over(w))


def prefixes(ranked: DataFrame) -> DataFrame:
    """The first k predictors, for every k (one target has few predictors)."""
    w = Window.partitionBy("target").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("formula", F.array_join(F.collect_list("predictor").over(w), "+"))


def nested_models(
    df: DataFrame, ranked: DataFrame, predictors: Sequence[str], targets: Sequence[str]
) -> DataFrame:
    """Least-squares models on the first k ranked predictors: BIC, adjusted
    R squared, F and p, and the distance to the lowest BIC."""
    names = list(predictors)
    p = len(names)

    def fit(key: tuple, sums: pd.DataFrame, order: pd.DataFrame) -> pd.DataFrame:
        n, _, c = centred(as_matrix(sums, p + 1))
        order = order.sort_values("row")
        at = [names.index(v) for v in order["predictor"]]
        total, out = c[p, p], []
        for k in range(1, len(at) + 1):
            use = at[:k]
            b = np.linalg.lstsq(c[np.ix_(use, use)], c[use, p], rcond=None)[0]
            rss = total - b @ c[use, p]
            left = n - k - 1
            bic = n * np.log(2 * np.pi) + n * np.log(rss / n) + n + np.log(n) * (k + 2)
            adj = 1 - (rss / left) / (total / (n - 1))
            f = ((total - rss) / k) / (rss / left)
            out.append((key[0], k, float(n), bic, adj, f, float(f_tail(f, k, left))))
        return pd.DataFrame(out, columns=["target", "row", "n", "bic", "r_sq_adj", "f", "p"])

    schema = "target string, row int, n double, bic double, r_sq_adj double, f double, p double"
    models = (
        target_moments(df, names, targets).groupBy("target")
        .cogroup(ranked.select("target", "predictor", "row").groupBy("target"))
        .applyInPandas(fit, schema)
    )
    least = F.min("bic").over(Window.partitionBy("target"))
    return (
        ranked.join(models, ["target", "row"])
        .withColumn("bic_diff_to_min", F.col("bic") - least)
    )


def target_correlations(
    df: DataFrame, predictors: Sequence[str], targets: Sequence[str]
) -> DataFrame:
    """Correlation test of each predictor with each target."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.lit(x).alias("predictor"),
                 F.col(t).cast("double").alias("a"), F.col(x).cast("double").alias("b"))
        for t in targets for x in predictors
    ]))
    long = df.select(rows.alias("v")).select("v.*").where("a IS NOT NULL AND b IS NOT NULL")
    return finish_test(
        long.groupBy("target", "predictor").agg(F.corr("a", "b").alias("r"), F.count(F.lit(1)).alias("n"))
    )


def chosen(models: DataFrame) -> DataFrame:
    """Predictors up to the row with the lowest BIC, per target."""
    best = models.where("bic_diff_to_min = 0").groupBy("target").agg(F.min("row").alias("best_row"))
    return models.join(best, "target").where(F.col("row") <= F.col("best_row")).drop("best_row")


def choose_predictors(
    df: DataFrame, key: str, predictors: Sequence[str], targets: Sequence[str],
    fit_on: str = "all", alpha: float = ALPHA, length: int = PATH_LENGTH,
) -> DataFrame:
    """Rank on the training rows, fit nested models, report every prefix.

    ``fit_on`` is "all" (models use every row) or "train".
    """
    train = df.where(train_flag(key))
    # A few rows per target, used twice below; the path is solved once.
    ranked = cut(rank_predictors(elastic_net_path(train, predictors, targets, alpha, length)))
    models = nested_models(df if fit_on == "all" else train, ranked, predictors, targets)
    r = target_correlations(train, predictors, targets).select(
        "target", "predictor", F.col("r").alias("target_r"), F.col("p").alias("target_p")
    )
    return models.join(r, ["target", "predictor"])
