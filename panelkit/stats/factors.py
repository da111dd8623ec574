"""How many factors a set of items has: the rules of a scree test, with parallel analysis.

Eigenvalues come from one moment pass over all complete rows. Parallel analysis compares
them with those of tables whose columns are shuffled independently, so that nothing
correlates; all replicates share one more moment pass with a replicate axis.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corr import factor_screen
from .moments import as_matrix, centred, centres

REPLICATES, SHARE, BLOCK_ROWS = 50, 0.95, 4_096


def shuffled_eigenvalues(
    df: DataFrame, cols: Sequence[str], replicates: int = REPLICATES, block_rows: int = BLOCK_ROWS, seed: int = 1,
) -> DataFrame:
    """``replicate``, ``k``, ``eigenvalue`` of correlation matrices of shuffled columns.

    Rows are dealt by a keyed hash into blocks of about ``block_rows``, and each column is
    shuffled inside its block. Blocks are random samples, so what correlation stays between
    their means is one part in ``block_rows`` of the original. Blocks and shuffles depend on
    the rows and the seed only, not on the partitioning. Constant columns are left out.
    """
    k, cols = len(cols), list(cols)
    centre = np.array(centres(df, cols))
    data = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("_v"))
    blocks = max(1, math.ceil(data.count() / block_rows))
    h = F.xxhash64("_v", F.lit(seed))
    dealt = data.select(F.pmod(h, F.lit(blocks)).alias("_b"), h.alias("_h"), "_v").repartition("_b").sortWithinPartitions("_b", "_h", "_v")
    upper = np.triu_indices(k + 1)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((replicates, k + 1, k + 1))

        def add(block: int, parts: list[np.ndarray]) -> None:
            x = np.concatenate(parts) - centre
            x = x[~np.isnan(x).any(1)]
            for r in range(replicates):
                mixed = np.random.default_rng([seed, r, block]).permuted(x, axis=0)
                mixed = np.column_stack([np.ones(len(x)), mixed])
                total[r] += mixed.T @ mixed

        now, parts = None, []
        for batch in batches:
            for block, part in batch.groupby("_b", sort=False):
                if block != now and parts:
                    add(now, parts)
                    parts = []
                now = int(block)
                parts.append(np.stack(part["_v"].to_numpy()).astype(float))
        if parts:
            add(now, parts)
            for r in range(replicates):
                yield pd.DataFrame({"replicate": r, "i": upper[0].astype("int32"), "j": upper[1].astype("int32"), "s": total[r][upper]})

    sums = dealt.mapInPandas(products, "replicate int, i int, j int, s double").groupBy("replicate", "i", "j").agg(F.sum("s").alias("s"))

    def values(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, _, c = centred(as_matrix(rows, k))
        own = np.flatnonzero(np.diag(c) > 0)
        sd = np.sqrt(np.diag(c)[own])
        found = np.linalg.eigvalsh(c[np.ix_(own, own)] / np.outer(sd, sd))[::-1] if len(own) else np.zeros(0)
        return pd.DataFrame({"replicate": np.int32(key[0]), "k": np.arange(1, len(found) + 1, dtype="int32"), "eigenvalue": found})

    return sums.groupBy("replicate").applyInPandas(values, "replicate int, k int, eigenvalue double")


def scree_rules(df: DataFrame, cols: Sequence[str], share: float = SHARE, **shuffling: int) -> DataFrame:
    """Each eigenvalue with what the rules compare it with.

    ``parallel`` is the ``share`` quantile of the shuffled eigenvalues of that rank,
    ``predicted`` the value at k of the line through the next eigenvalue and the last one
    (optimal coordinates; none for the last two), ``acceleration`` the second difference.
    """
    screen = factor_screen(df, cols).select("k", "eigenvalue", "share", "acceleration")
    shuffled = shuffled_eigenvalues(df, cols, **shuffling).groupBy("k").agg(F.percentile("eigenvalue", F.lit(share)).alias("parallel"))
    held = screen.join(shuffled, "k", "left").withColumn("_all", F.lit(0))

    def rules(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k").drop(columns="_all")
        e = rows["eigenvalue"].to_numpy(float)
        e = e[~np.isnan(e)]
        p, at = len(e), np.arange(1, len(e) + 1)
        predicted = np.full(len(rows), np.nan)
        if p > 2:
            slope = (e[-1] - e[1:-1]) / (p - at[1:-1])
            predicted[:p - 2] = e[1:-1] - slope
        rows["predicted"] = predicted
        return rows

    # One row per column: k x k moments are the only thing that met one task before.
    out = held.groupBy("_all").applyInPandas(rules, "k int, eigenvalue double, share double, acceleration double, parallel double, predicted double")
    return out.withColumn("predicted", F.nanvl("predicted", F.lit(None)))


def factor_counts(rules: DataFrame, reference: str = "parallel") -> DataFrame:
    """One row: factors by each rule. ``n_kaiser`` counts eigenvalues of at least their mean,
    ``n_parallel`` the leading ones above ``parallel``, ``n_optimal`` the leading ones that also
    reach ``predicted``, ``n_elbow`` those before the largest acceleration. ``reference`` names
    what optimal coordinates need besides: ``parallel``, or ``one`` for eigenvalues of at least 1."""
    if reference not in ("parallel", "one"):
        raise ValueError("reference is 'parallel' or 'one'")
    bar = F.col("parallel") if reference == "parallel" else F.lit(1.0)
    size = F.count("eigenvalue")
    first_no = lambda yes: F.min(F.when(~F.coalesce(yes, F.lit(False)), F.col("k")))
    e = F.col("eigenvalue")
    leading = lambda yes: F.coalesce(first_no(yes) - 1, size).cast("int")
    return rules.where(e.isNotNull()).agg(
        size.cast("int").alias("n_items"),
        F.count_if(e >= 1).cast("int").alias("n_kaiser"),
        leading(e > F.col("parallel")).alias("n_parallel"),
        leading((e >= bar) & (e >= F.col("predicted"))).alias("n_optimal"),
        F.coalesce(F.max_by(F.col("k") - 1, F.nanvl("acceleration", F.lit(None))), F.lit(0)).cast("int").alias("n_elbow"),
    )
