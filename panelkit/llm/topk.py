"""Exact top-k inner products by pivot-table elimination.

A largest inner product is a least distance once candidates get one more coordinate
that brings them all to the same length M: |q - x|^2 = |q|^2 + M^2 - 2 q.x. In that
space each candidate's distances to the pivots are computed once and stored. For a
query the largest difference to its own pivot distances is a lower bound of the
distance; candidates are evaluated in the order of their bounds, and the search stops
where no bound can reach the k-th score.

Queries are sent in chunks of about ``chunk`` vectors, the only thing broadcast besides
the pivots, so their size is bounded; each chunk passes over the stored candidates and
keeps k rows per query and task. Pivots come farthest-first from a bounded sample; they
affect speed only, every candidate is covered and results are exact.

Defined results: vectors that are null or hold null or non-finite components take no
part; vectors are compared with vectors of their length only, an empty one scores 0;
equal scores go to the smaller id, then to the row stored first; repeated rows are
candidates of each other; a null id is no query and comes last among equals; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

PIVOTS, SAMPLE, CHUNK = 16, 2_000, 2_048


def integer_vectors(rows: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """uid, id, v (floor of 256 times each component, as double) and dim."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double"))
    return rows.where(F.col(vector).isNotNull() & usable).select(
        F.monotonically_increasing_id().alias("uid"), F.col(id).cast("long").alias("id"), whole.alias("v"),
        F.size(vector).alias("dim"))


def farthest_first(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample: each the farthest from those before."""
    picked = [0]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(count, len(sample)):
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def _stacked(vectors: list, dim: int) -> np.ndarray:
    return np.array(vectors, float).reshape(len(vectors), dim)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim)


def _pivot_distances(x: np.ndarray, pivots: np.ndarray, most: float, query: bool) -> np.ndarray:
    """Distances from vectors (with their extra coordinate; 0 for queries) to pivots."""
    square = (x * x).sum(1)
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(most - square, 0))
    own = np.sqrt(np.maximum(most - (pivots * pivots).sum(1), 0))
    plain = square[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(plain + (extra[:, None] - own[None]) ** 2, 0))


def pivot_table(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> tuple[DataFrame, dict]:
    """The vectors with ``d``, their pivot distances; and per length (pivots, M^2)."""
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    vectors = cut(vectors.repartition(tasks))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    most = {r.dim: r.m for r in vectors.groupBy("dim").agg(F.max(square).alias("m")).collect()}
    drawn = vectors.select("dim", "v").orderBy(F.xxhash64("uid"), "uid").limit(sample).collect()
    space = {}
    for dim, m in most.items():
        own = _stacked([r.v for r in drawn if r.dim == dim], dim)
        space[dim] = (farthest_first(own, pivots) if len(own) else np.zeros((1, dim)), m)

    def run(batches):
        for batch in batches:
            dims = batch["dim"].to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part["v"], dim)
                d = _pivot_distances(x, space[dim][0], space[dim][1], False)
                yield pa.record_batch([*part.columns, pa.array(list(d), pa.list_(pa.float64()))], names=[*part.schema.names, "d"])

    return cut(vectors.mapInArrow(run, "uid long, id long, v array<double>, dim int, d array<double>")), space


class Search:
    """The running k best of the queries of one length."""

    def __init__(self, uids, queries: np.ndarray, pivots: np.ndarray, most: float, k: int):
        self.uids, self.q, self.k, self.most = uids, queries, k, most
        self.d = _pivot_distances(queries, pivots, most, True)
        self.square = (queries * queries).sum(1)
        self.best: list[list[tuple]] = [[] for _ in uids]
        # Room for rounding in computed distances.
        self.slack = 1e-9 * (most + float(self.square.max(initial=0)) + 1)

    def add(self, x: np.ndarray, d: np.ndarray, ids: list, uids: np.ndarray) -> None:
        top = float(np.abs(x).max(initial=0)) * float(np.abs(self.q).max(initial=0)) * max(x.shape[1], 1)
        if top < 2**24:  # every sum is exact in this type
            x, q = x.astype(np.float32), self.q.astype(np.float32)
        elif top < 2**53:
            q = self.q
        else:
            x, q = x.astype(object), self.q.astype(object)
            x[:], q[:] = np.vectorize(int, otypes=[object])(x), np.vectorize(int, otypes=[object])(q)
        d = np.ascontiguousarray(d.T)
        gap, low = np.empty(len(x)), np.empty(len(x))
        for i, uid in enumerate(self.uids):
            low.fill(0)
            for p in range(len(d)):
                np.subtract(d[p], self.d[i, p], out=gap)
                np.abs(gap, out=gap)
                np.maximum(low, gap, out=low)
            bound = (self.square[i] + self.most - low * low) / 2 + self.slack
            best = self.best[i]
            if len(best) >= self.k:
                alive = np.flatnonzero(bound >= best[-1][0])
                order = alive[np.argsort(-bound[alive], kind="stable")]
            else:
                order = np.argsort(-bound, kind="stable")
            at, step = 0, 64
            while at < len(order):
                if len(best) >= self.k and bound[order[at]] < best[-1][0]:
                    break
                rows = order[at:at + step]
                scores = x[rows] @ q[i]
                near = rows if len(best) < self.k else rows[scores >= best[-1][0]]
                if len(near):
                    value = scores if len(near) == len(rows) else scores[scores >= best[-1][0]]
                    more = [(int(s), ids[r], int(uids[r])) for s, r in zip(value.tolist(), near.tolist(), strict=True) if uids[r] != uid]
                    best += more
                    best.sort(key=lambda b: (-b[0], b[1] is None, b[1] or 0, b[2]))
                    del best[self.k:]
                at, step = at + step, min(step * 2, 2048)


def search(rows: DataFrame, k: int = 5, every: int = 50, id: str = "vec_id", vector: str = "embedding",
           chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query row."""
    spark = rows.sparkSession
    table, space = pivot_table(integer_vectors(rows, id, vector))
    queries = table.where(F.col("id") % every == 0)
    parts = max(1, math.ceil(queries.count() / chunk))
    out = None
    for part in range(parts):
        asked = queries.where(F.pmod(F.xxhash64("uid"), F.lit(parts)) == part).select("uid", "id", "v", "dim").collect()
        by_dim: dict[int, list] = {}
        for r in asked:
            by_dim.setdefault(r.dim, []).append(r)
        sent = spark.sparkContext.broadcast({dim: (
            [r.uid for r in own], [r.id for r in own], _stacked([r.v for r in own], dim)) for dim, own in by_dim.items()})

        def run(batches, sent=sent):
            states = {dim: Search(uids, q, *space[dim], k) for dim, (uids, _, q) in sent.value.items()}
            for batch in batches:
                dims = batch["dim"].to_numpy(zero_copy_only=False)
                for dim in np.unique(dims).tolist():
                    if dim in states:
                        own = batch.filter(pa.array(dims == dim))
                        states[dim].add(_matrix(own["v"], dim), _matrix(own["d"], len(space[dim][0])),
                                        own["id"].to_pylist(), own["uid"].to_numpy(zero_copy_only=False))
            found = [(u, i, b[1], b[2], b[0]) for dim, s in states.items()
                     for u, i, best in zip(s.uids, sent.value[dim][1], s.best, strict=True) for b in best]
            for at in range(0, len(found), 10_000):
                columns = list(zip(*found[at:at + 10_000], strict=True))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["quid", "query_id", "vec_id", "uid", "score"])

        hits = table.mapInArrow(run, "quid long, query_id long, vec_id long, uid long, score long")
        place = F.row_number().over(Window.partitionBy("quid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid"))
        best = hits.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if parts > 1:
            best = cut(best)  # a chunk is done before the next is sent
        out = best if out is None else out.unionByName(best)
    return out
