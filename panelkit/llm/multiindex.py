"""Approximate nearest neighbours by cosine over an inverted multi-index.

Unit vectors are cut into two halves and each half is quantised by a codebook of its
own, so a pair of centroids names a cell and two small codebooks make a fine grid. A
query walks the pairs in the order of the summed distances of its halves (a heap over
the two sorted lists of centroids) until the cells walked hold ``budget`` vectors;
those are reranked by the cosine of the original vectors.

* Equal vectors are one entry with their ``k + 1`` smallest ids, cut to that many per
  task before they meet, so a vector that fills a third of the table is searched once.
* Codebooks are fitted on at most ``SAMPLE`` vectors, those with the smallest hashes;
  every vector is indexed. The budget is measured, not set: ``PROBES`` queries are
  compared with all vectors, and the least budget that finds ``recall`` of their true
  neighbours holds for all (1.0: every cell is walked and the result is exact).
* Entries lie in blocks of neighbouring cells with at most ``BLOCK`` entries; a larger
  cell takes several blocks. A block meets the queries that walk its cells in one sorted
  stream; blocks that many queries walk are dealt to several tasks. Sent to every task
  are only the codebooks and one count per cell, at most ``CENTROIDS``^2 per length.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part; vectors are compared with vectors of their length only; equal scores go to the
smaller id, a null id is no query and comes last; repeated rows are neighbours of each
other; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

SAMPLE, CENTROIDS, PROBES, BLOCK, WALKS = 10_000, 256, 256, 2_048, 20_000
ROUNDING = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def centroids(x: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """Least-squares centroids; an emptied one moves to the point farthest from its own."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), count, replace=False)]
    for _ in range(rounds):
        d = _squares(x, c)
        near = d.argmin(1)
        size = np.bincount(near, minlength=count)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        lost = np.flatnonzero(size == 0)
        c = total / np.maximum(size, 1)[:, None]
        if len(lost):
            c[lost] = x[np.argsort(-d[np.arange(len(x)), near], kind="stable")[:len(lost)]]
    return c


class Grid:
    """The cells of one vector length, their sizes and their blocks."""

    def __init__(self, dim: int, sample: np.ndarray, entries: int, most: int):
        self.half = dim // 2
        count = max(1, min(most, len(sample), round(math.sqrt(entries / 4))))
        x = unit(sample) if len(sample) else np.zeros((1, dim))
        self.books = [centroids(h, min(count, len(x))) for h in (x[:, :self.half], x[:, self.half:])]
        self.wide = len(self.books[1])

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squares(x[:, :self.half], self.books[0]), _squares(x[:, self.half:], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = self.distances(x)
        return one.argmin(1) * self.wide + two.argmin(1)

    def lay(self, cells: np.ndarray, sizes: np.ndarray, first: int, block: int) -> int:
        """Number the blocks from ``first``; returns the next free number."""
        self.size = np.zeros(len(self.books[0]) * self.wide, np.int64)
        self.size[cells] = sizes
        self.first, self.parts = np.zeros_like(self.size), np.ones_like(self.size)
        at, room = first, block
        for cell in np.flatnonzero(self.size):
            n = int(self.size[cell])
            if n > room and room < block:
                at, room = at + 1, block
            self.first[cell] = at
            if n > block:
                self.parts[cell] = -(-n // block)
                at += int(self.parts[cell])
            else:
                room -= n
        return at + 1

    def walk(self, one: np.ndarray, two: np.ndarray, budget: int) -> list[int]:
        """Cells in the order of one[a] + two[b] until they hold ``budget`` entries."""
        rows, columns = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        a_of, b_of = one[rows].tolist(), two[columns].tolist()
        base, step = (rows * self.wide).tolist(), columns.tolist()
        size, out, got = self.size, [], 0
        # Row a enters the heap once row a - 1 has started: its first pair is no better.
        heap = [(a_of[0] + b_of[0], 0, 0)]
        while heap and got < budget:
            _, a, b = heapq.heappop(heap)
            cell = base[a] + step[b]
            n = size[cell]
            if n:
                out.append(cell)
                got += int(n)
            if b == 0 and a + 1 < len(a_of):
                heapq.heappush(heap, (a_of[a + 1] + b_of[0], a + 1, 0))
            if b + 1 < len(b_of):
                heapq.heappush(heap, (a_of[a] + b_of[b + 1], a, b + 1))
        return out


def entries(rows: DataFrame, k: int, id: str, vector: str) -> DataFrame:
    """gid, v, dim and the k + 1 smallest ids of each distinct usable vector."""
    number = F.transform(vector, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    usable = (F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists(vector, lambda x: x != 0))
    own = rows.where(F.col(vector).isNotNull()).where(usable).select(F.col(id).cast("long").alias("id"), number.alias("v")).withColumn("h", F.xxhash64("v"))
    place = F.row_number().over(Window.partitionBy("h", "v").orderBy(F.col("id").asc_nulls_last()))
    few = own.withColumn("place", place).where(F.col("place") <= k + 1)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda s: s["id"])
    return few.groupBy("h", "v").agg(listed.alias("ids")).select(
        F.monotonically_increasing_id().alias("gid"), "v", F.size("v").alias("dim"), "ids")


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _by_dim(batch: pa.RecordBatch):
    dims = batch["dim"].to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        yield dim, batch if (dims == dim).all() else batch.filter(pa.array(dims == dim))


def _drawn(table: DataFrame, count: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """gids and vectors of the entries with the smallest hashes, by length."""
    got = table.select("gid", "dim", "v").orderBy(F.xxhash64("v", F.lit("drawn")), "gid").limit(count).toArrow().combine_chunks()
    return {dim: (part["gid"].to_numpy(), _matrix(part["v"], dim)) for batch in got.to_batches() for dim, part in _by_dim(batch)}


def build(table: DataFrame, most: int = CENTROIDS, block: int = BLOCK) -> tuple[DataFrame, dict[int, Grid]]:
    """The entries with their cell, and the grid of each length."""
    numbers = {r["dim"]: r["count"] for r in table.groupBy("dim").count().collect()}
    drawn = _drawn(table, SAMPLE)
    grids = {dim: Grid(dim, drawn[dim][1] if dim in drawn else np.zeros((0, dim)), n, most) for dim, n in sorted(numbers.items())}

    def place(batches):
        for batch in batches:
            for dim, part in _by_dim(batch):
                cell = grids[dim].cells(unit(_matrix(part["v"], dim)))
                yield pa.record_batch([*part.columns, pa.array(cell.astype(np.int32))], names=[*part.schema.names, "cell"])

    held = stored(table.mapInArrow(place, "gid long, v array<double>, dim int, ids array<long>, cell int"), "cells")
    sizes = held.groupBy("dim", "cell").count().toArrow().to_pandas()
    at = 0
    for dim, grid in grids.items():
        own = sizes[sizes["dim"] == dim]
        at = grid.lay(own["cell"].to_numpy(), own["count"].to_numpy(), at, block)
    return held, grids


def budgets(held: DataFrame, grids: dict[int, Grid], asked: DataFrame, k: int, recall: float) -> dict[int, int]:
    """Per length: how many entries to walk for so large a share of the true neighbours
    of some of the queries. The share is taken per length."""
    if recall >= 1:
        return {dim: int(g.size.sum()) for dim, g in grids.items()}
    probes = {dim: (gids, unit(x)) for dim, (gids, x) in _drawn(asked, PROBES).items()}

    def run(batches):
        best: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for dim, part in _by_dim(batch):
                if dim not in probes:
                    continue
                gids, q = probes[dim]
                own = part["gid"].to_numpy(zero_copy_only=False)
                s = q @ unit(_matrix(part["v"], dim)).T
                s[gids[:, None] == own[None]] = -2
                s = np.concatenate([best[dim][0], s], 1) if dim in best else s
                c = np.broadcast_to(part["cell"].to_numpy(zero_copy_only=False), (len(q), part.num_rows))
                c = np.concatenate([best[dim][1], c], 1) if dim in best else c
                top = np.argsort(-s, 1, kind="stable")[:, :k]
                best[dim] = [np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)]
        for dim, (s, c) in best.items():
            q = np.repeat(np.arange(len(s)), s.shape[1])
            yield pa.record_batch([pa.array(np.full(len(q), dim, np.int32)), pa.array(q), pa.array(s.ravel()), pa.array(c.ravel().astype(np.int32))],
                                  names=["dim", "q", "score", "cell"])

    near = held.select("gid", "v", "dim", "cell").mapInArrow(run, "dim int, q long, score double, cell int").where("score > -2")
    place = F.row_number().over(Window.partitionBy("dim", "q").orderBy(F.desc("score"), "cell"))
    found = near.withColumn("place", place).where(F.col("place") <= k).select("dim", "q", "cell").toArrow().to_pandas()
    out = {}
    for dim, grid in grids.items():
        own = found[found["dim"] == dim]
        needed = []
        for q, part in own.groupby("q"):
            one, two = grid.distances(probes[dim][1][q:q + 1])
            order = np.argsort((one[0][:, None] + two[0][None]).ravel(), kind="stable")
            upto = np.empty(len(order), np.int64)
            upto[order] = np.cumsum(grid.size[order])
            needed += upto[part["cell"].to_numpy()].tolist()
        needed.sort()
        out[dim] = max(k + 1, needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) if needed else int(grid.size.sum())
    return out


def _walks(asked: DataFrame, grids: dict[int, Grid], budget: dict[int, int]) -> DataFrame:
    """block, gid, dim, v, cells of every block a query walks into."""

    def run(batches):
        for batch in batches:
            for dim, part in _by_dim(batch):
                grid, gids, v = grids[dim], part["gid"], part["v"]
                one, two = grid.distances(unit(_matrix(v, dim)))
                at, block, cells = [], [], []
                for i in range(len(one)):
                    walked = np.array(grid.walk(one[i], two[i], budget[dim]), np.int64)
                    times = grid.parts[walked]
                    first = np.repeat(grid.first[walked] - np.cumsum(times) + times, times) + np.arange(times.sum())
                    order = np.argsort(first, kind="stable")
                    names, starts = np.unique(first[order], return_index=True)
                    at += [i] * len(names)
                    block += names.tolist()
                    cells += np.split(np.repeat(walked, times)[order].astype(np.int32), starts[1:])
                    if len(at) > 5_000:
                        yield _walk_batch(at, block, cells, gids, v, dim)
                        at, block, cells = [], [], []
                if at:
                    yield _walk_batch(at, block, cells, gids, v, dim)

    return asked.select("gid", "v", "dim").mapInArrow(run, "block long, gid long, dim int, v array<double>, cells array<int>")


def _walk_batch(at, block, cells, gids, v, dim) -> pa.RecordBatch:
    rows = pa.array(at)
    offsets = np.concatenate(([0], np.cumsum([len(c) for c in cells])))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(cells)))
    return pa.record_batch([pa.array(block, pa.int64()), gids.take(rows), pa.array(np.full(len(at), dim, np.int32)), v.take(rows), lists],
                           names=["block", "gid", "dim", "v", "cells"])


class Block:
    """The entries of one block, as they come in."""

    def __init__(self, dim: int):
        self.dim, self.parts = dim, []

    def add(self, part: pa.RecordBatch) -> None:
        low = part["low"].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.parts.append((part["gid"].to_numpy(zero_copy_only=False), _matrix(part["v"], self.dim),
                           part["cells"].flatten().to_numpy(zero_copy_only=False), low, part["low"].is_null().to_numpy(zero_copy_only=False)))

    def close(self) -> None:
        self.gid, v, cell, self.low, self.no_id = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts = []
        self.v = scaled(v)
        self.norm = np.sqrt((self.v * self.v).sum(1))
        self.unit = self.v / self.norm[:, None]
        self.names, self.cell = np.unique(cell, return_inverse=True)

    def near(self, part: pa.RecordBatch, k: int):
        """Query gids, entry gids, scores and least ids of each query's k best here."""
        q = scaled(_matrix(part["v"], self.dim))
        norm = np.sqrt((q * q).sum(1))
        lists = part["cells"]
        count = np.diff(lists.offsets.to_numpy())
        asked = np.searchsorted(self.names, lists.flatten().to_numpy(zero_copy_only=False))
        open_ = np.zeros((len(q), len(self.names)), bool)
        open_[np.repeat(np.arange(len(q)), count), asked] = True
        s = np.where(open_[:, self.cell], (q / norm[:, None]) @ self.unit.T, -2.0)
        least = np.partition(s, -k, 1)[:, -k] if s.shape[1] > k else np.full(len(s), -1.5)
        row, col = np.nonzero(s >= np.maximum(least - ROUNDING, -1.5)[:, None])
        exact = (q[row] * self.v[col]).sum(1) / (norm[row] * self.norm[col])
        qgid = part["gid"].to_numpy(zero_copy_only=False)[row]
        return qgid, self.gid[col], exact, self.low[col], self.no_id[col]


def _scored(held: DataFrame, walks: DataFrame, grids: dict[int, Grid], k: int) -> DataFrame:
    """qgid, gid, score, low: per query and block its best entries."""

    def place(batches):
        for batch in batches:
            for dim, part in _by_dim(batch):
                grid = grids[dim]
                cell, gid = (part[c].to_numpy(zero_copy_only=False) for c in ("cell", "gid"))
                own = grid.first[cell] + (gid * np.int64(0x9E3779B1) >> np.int64(7)) % grid.parts[cell]
                yield pa.record_batch([pa.array(own), part["gid"], part["dim"], part["v"], part["cell"], part["ids"]],
                                      names=["block", "gid", "dim", "v", "cell", "ids"])

    laid = held.mapInArrow(place, "block long, gid long, dim int, v array<double>, cell int, ids array<long>")
    deal = walks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / WALKS).alias("deals"))
    base = laid.join(deal, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("deals").cast("int") - 1)).alias("deal"), F.lit(0).alias("kind"), "gid", "dim", "v",
        F.array("cell").alias("cells"), F.col("ids")[0].alias("low"))
    asking = walks.join(deal, "block").select(
        "block", F.pmod(F.xxhash64("gid"), "deals").cast("int").alias("deal"), F.lit(1).alias("kind"), "gid", "dim", "v", "cells",
        F.lit(None).cast("long").alias("low"))

    def run(batches):
        now, held_block = None, None
        for batch in batches:
            block, deal, kind = (batch[c].to_numpy(zero_copy_only=False) for c in ("block", "deal", "kind"))
            change = np.flatnonzero((np.diff(block) != 0) | (np.diff(deal) != 0) | (np.diff(kind) != 0)) + 1
            edges = [0, *change.tolist(), len(block)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    if now != (block[a], deal[a]):
                        now, held_block = (block[a], deal[a]), Block(part["dim"][0].as_py())
                    held_block.add(part)
                    continue
                if now != (block[a], deal[a]):
                    continue
                if held_block.parts:
                    held_block.close()
                for at in range(0, b - a, 256):
                    qgid, gid, score, low, no_id = held_block.near(part.slice(at, 256), k)
                    yield pa.record_batch([pa.array(qgid), pa.array(gid), pa.array(score), pa.array(low, mask=no_id)],
                                          names=["qgid", "gid", "score", "low"])

    return base.unionByName(asking).repartition("block", "deal").sortWithinPartitions("block", "deal", "kind").mapInArrow(
        run, "qgid long, gid long, score double, low long")


def search(rows: DataFrame, k: int = 5, every: int = 50, recall: float = 0.95, id: str = "vec_id", vector: str = "embedding",
           most: int = CENTROIDS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found of each row whose id ``every`` divides."""
    own = rows.select(F.col(id).alias(id), F.col(vector).alias(vector))
    held, grids = build(stored(entries(own, k, id, vector), "entries"), most, block)
    # Queries by vector: which entry, and the query rows of it.
    usable = own.where((F.col(id) % every == 0) & F.col(vector).isNotNull())
    number = F.transform(vector, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    rows_of = usable.select(F.col(id).cast("long").alias("query_id"), number.alias("v")).join(held.select("gid", "v"), "v").select("query_id", "gid")
    rows_of = stored(rows_of.withColumn("row", F.monotonically_increasing_id()), "queries")
    asked = held.join(rows_of.select("gid").distinct(), "gid", "left_semi").select("gid", "v", "dim")
    walks = stored(_walks(asked.repartition(F.xxhash64("gid")), grids, budgets(held, grids, asked, k, recall)), "walks")

    hits = _scored(held, walks, grids, k + 1)
    place = F.row_number().over(Window.partitionBy("qgid").orderBy(F.desc("score"), F.col("low").asc_nulls_last(), "gid"))
    best = stored(hits.withColumn("place", place).where(F.col("place") <= k + 1).select("qgid", "gid", "score"), "best")
    listed = best.join(held.select("gid", "ids"), "gid")
    # A query's own row is among the copies of its vector, if its id is one of those listed.
    each = rows_of.join(listed.withColumnRenamed("gid", "egid"), F.col("gid") == F.col("qgid")).select(
        "row", "query_id", "gid", "egid", "score", "ids", F.posexplode("ids").alias("pos", "vec_id"))
    same = (F.col("egid") == F.col("gid")) & (F.col("pos") + 1 == F.array_position("ids", F.col("query_id")))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "egid", "pos"))
    return each.where(~same).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
