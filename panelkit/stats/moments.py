"""Sums, cross-products and pairwise counts in one distributed pass.

Each task turns its Arrow batches into k x k blocks; the blocks are added per
(group, row, column). What leaves the cluster has k x k numbers per group,
whatever the row count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Groups whose blocks a task holds before it passes them on.
HELD_GROUPS = 500


def centres(df: DataFrame, cols: Sequence[str]) -> list[float]:
    """Overall means, used to keep sums of squares well conditioned."""
    row = df.agg(*[F.avg(F.col(c).cast("double")) for c in cols]).first()
    return [float(v) if v is not None else 0.0 for v in row]


def cross_products(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), centre: Sequence[float] | None = None,
    expand: Callable[[np.ndarray], np.ndarray] | None = None, width: int | None = None,
) -> DataFrame:
    """Long table (by, i, j, s): sum of products of complete rows.

    Index 0 is the constant 1, so (0, 0) is the row count and (0, i) the sum
    of column i after subtracting its centre. Only i <= j is kept. ``expand``
    turns a batch of the columns into ``width`` derived ones (a design matrix)
    inside the task.
    """
    k = width or len(cols)
    centre = np.array(centres(df, cols) if centre is None else centre)
    # Incomplete rows are dropped in the task: a condition on all columns makes the planner
    # infer one constraint for every set of cast columns.
    data = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    upper = np.triu_indices(k + 1)
    schema = T.StructType(
        [data.schema[b] for b in by]
        + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
           T.StructField("s", T.DoubleType())]
    )
    by = list(by)
    cols = list(cols)

    def rows_of(sums: dict[tuple, np.ndarray]) -> Iterator[pd.DataFrame]:
        for key, block in sums.items():
            out = pd.DataFrame({"i": upper[0].astype("int32"), "j": upper[1].astype("int32"),
                                "s": block[upper]})
            for n, v in zip(by, key):
                out[n] = v
            yield out[[*by, "i", "j", "s"]]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            groups = batch.groupby(by, dropna=False, sort=False) if by else [((), batch)]
            for key, part in groups:
                x = part[cols].to_numpy(float) - centre
                x = x[~np.isnan(x).any(1)]
                if not len(x):
                    continue
                x = np.column_stack([np.ones(len(x)), expand(x) if expand else x])
                block = x.T @ x
                key = key if isinstance(key, tuple) else (key,)
                sums[key] = sums.get(key, 0.0) + block
            if len(sums) > HELD_GROUPS:
                yield from rows_of(sums)
                sums = {}
        yield from rows_of(sums)

    return data.mapInPandas(blocks, schema).groupBy(*by, "i", "j").agg(F.sum("s").alias("s"))


def as_matrix(rows: pd.DataFrame, k: int) -> np.ndarray:
    """Symmetric (k+1) x (k+1) matrix from (i, j, s) rows."""
    m = np.zeros((k + 1, k + 1))
    m[rows["i"], rows["j"]] = rows["s"]
    return np.triu(m) + np.triu(m, 1).T


def centred(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Row count, means (about the centre) and centred cross-products."""
    n = m[0, 0]
    sums = m[0, 1:]
    return n, sums / n, m[1:, 1:] - np.outer(sums, sums) / n


def covariances(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Covariance and correlation of each column pair over complete rows."""
    k, cols, by = len(cols), list(cols), list(by)
    sums = cross_products(df, cols, by)
    schema = T.StructType(
        [sums.schema[b] for b in by]
        + [T.StructField("x", T.StringType()), T.StructField("y", T.StringType()),
           T.StructField("n", T.LongType()), T.StructField("cov", T.DoubleType()),
           T.StructField("r", T.DoubleType())]
    )

    def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, _, c = centred(as_matrix(rows, k))
        i, j = np.triu_indices(k)
        with np.errstate(invalid="ignore", divide="ignore"):
            out = pd.DataFrame({
                "x": np.array(cols)[i], "y": np.array(cols)[j], "n": int(round(n)),
                "cov": c[i, j] / (n - 1), "r": c[i, j] / np.sqrt(c[i, i] * c[j, j]),
            })
        for name, v in zip(by, key):
            out[name] = v
        return out[[*by, "x", "y", "n", "cov", "r"]]

    keyed = sums if by else sums.withColumn("_all", F.lit(0))
    grouped = keyed.groupBy(*by) if by else keyed.groupBy("_all")
    return grouped.applyInPandas(finish if by else (lambda rows: finish((), rows)), schema)


def pairwise_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation of each column pair over the rows where both are present.

    One pass: products of values, squares and presence marks.
    """
    k, cols = len(cols), list(cols)
    centre = np.array(centres(df, cols))
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    i, j = np.triu_indices(k, 1)
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, len(i)))
        for batch in batches:
            x = batch.to_numpy(float) - centre
            m = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            mm, xm, qm, xx = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
            total += np.stack([mm[i, j], xm[i, j], xm[j, i], qm[i, j], qm[j, i], xx[i, j]])
        out = pd.DataFrame(total.T, columns=names)
        out.insert(0, "j", j.astype("int32"))
        out.insert(0, "i", i.astype("int32"))
        yield out

    schema = "i int, j int, " + ", ".join(f"{n} double" for n in names)
    sums = data.mapInPandas(blocks, schema).groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names])
    label = F.array(*[F.lit(c) for c in cols])
    num = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return sums.where("n > 1").select(
        F.element_at(label, F.col("i") + 1).alias("x"), F.element_at(label, F.col("j") + 1).alias("y"),
        F.col("n").cast("bigint").alias("n"), F.try_divide(num, F.sqrt(vx * vy)).alias("r"),
    )
