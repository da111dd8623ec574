"""Exact join of texts by Jaccard distance of word shingles, as a metric-space join.

Jaccard distance is a metric, and 1 between texts that share no shingle, so a pivot can
tell apart only texts that overlap it. Space is therefore first cut into cells by rare
shingles: a text of n shingles lies in the cells of its n - ceil(s * n) + 1 rarest ones,
and two texts at similarity s share one of them. The order of rarity comes from a sketch
of fixed size over all texts; any order is right, rare first keeps shared passages from
making large cells. Then, in every cell at once:

* Members are kept apart by size where sizes alone rule out a link, each lying in two
  neighbouring steps of a scale of sizes.
* The member that lacks fewest of its cells (then the smallest) is the pivot; the distance of each member to it is computed.
* Members within the threshold r of the pivot are linked to it, which settles links among
  them as far as components go. Members farther away form the region that is left.
* A linked member y can still reach that region only if d(y, pivot) >= least distance in
  the region - r (triangle inequality): such boundary members are replicated into it.
* The region gets the next pivot, and so on. Regions of few members, whose bound grows
  fourfold with each round, are joined pairwise, but for pairs whose sizes or distances to the last
  pivot differ too much; so rounds are logarithmic in a cell's size.
* Regions of one pivot become one where that halves their pairs, as near copies meet in many
  cells. Members known to be connected are not compared, and a region that holds no others
  is done.

Equal sets are one member from the start, so copies cost nothing. A pair met in many cells
is computed once, and only if class counts leave it open: coarse ones first, then, for texts of
many shingles, counts in as many classes as their size asks for. Joins on a hot pivot or cell
are plain joins that adaptive execution splits; cell figures are aggregated before the shuffle.

Defined results: null and empty texts have no shingles and are linked with nothing; fewer
words than a shingle form one shingle; a row without id has no component and is linked
with nothing; rows with the same id are one document; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .stored import release, stored
from .words import block_words, mix, text_blocks

SLOTS = 1 << 20  # of the sketch of shingle counts
LEAF = 16
CLASSES = 128
FINE = 4  # shingles to a class of the finer counts, at most
SETS_HELD = 1 << 20  # shingles of sets handed on at once
IDS_SENT = 400_000  # ids broadcast to find their texts; more are joined by a shuffle


def shingle_sets(column: pa.Array, k: int):
    """The sorted distinct shingle hashes of each row of a string column."""
    factors = [np.uint64((0xD6E8FEB86659FD93 * (2 * j + 1)) % (1 << 64)) for j in range(k)]
    for first, last, data, starts in text_blocks(column):
        words, at = block_words(data, starts)
        n = len(words)
        if n >= k:
            joint = words[:n - k + 1] * factors[0]
            for j in range(1, k):
                joint = joint + words[j:n - k + 1 + j] * factors[j]
            joint = mix(joint)
        for row in range(last - first):
            a, b = int(at[row]), int(at[row + 1])
            if b - a >= k:
                yield np.unique(joint[a:b - k + 1])
            elif b > a:
                # Fewer words: told apart from full shingles by their number.
                value = np.uint64(b - a)
                for w in words[a:b]:
                    value = mix(np.array([value]))[0] ^ w
                yield mix(np.array([value]))
            else:
                yield np.empty(0, np.uint64)


def rarity(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """Level of commonness by slot of a shingle's hash: 0 up to twice the mean count of a
    slot, then one more for each doubling. The sketch has SLOTS counts at any size."""
    pieces = 64
    width = SLOTS // pieces

    def run(batches):
        counts, held, size = np.zeros(SLOTS, np.int64), [], 0
        for batch in batches:
            for own in shingle_sets(batch.column(0), k):
                held.append((own & np.uint64(SLOTS - 1)).astype(np.int32))
                size += len(own)
                if size > 4 * SLOTS:
                    counts += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=SLOTS)
        for p in range(pieces):
            yield pa.record_batch({"p": pa.array([p], pa.int32()), "c": pa.array([counts[p * width:(p + 1) * width].tobytes()], pa.binary())})

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, c in zip(batch["p"].to_pylist(), batch["c"].to_pylist(), strict=True):
                held[p] = held[p] + np.frombuffer(c, np.int64) if p in held else np.frombuffer(c, np.int64)
        for p, c in held.items():
            yield pa.record_batch({"p": pa.array([p], pa.int32()), "c": pa.array([c.tobytes()], pa.binary())})

    form = "p int, c binary"
    sums = docs.select(docs[text].alias("t")).mapInArrow(run, form).repartition(pieces, "p").mapInArrow(add, form)
    total = np.zeros(SLOTS, np.int64)
    for r in sums.collect():  # SLOTS numbers in all
        total[r.p * width:(r.p + 1) * width] += np.frombuffer(r.c, np.int64)
    mean = max(1.0, float(total.mean()))
    return np.maximum(0, np.floor(np.log2(np.maximum(total, 1) / mean))).astype(np.uint8)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def class_counts(own: np.ndarray, classes: int) -> bytes:
    """Numbers of shingles in classes of hashes, up to 255 each."""
    return np.minimum(np.bincount((own >> np.uint64(40)).astype(np.int64) % classes, minlength=classes), 255).astype(np.uint8).tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """What the symmetric difference of two sets has at least, by class counts; numbers of
    classes are powers of two, and the larger one is folded to the other."""
    classes = min(len(x), len(y))
    x, y = (np.minimum(np.frombuffer(c, np.uint8).reshape(-1, classes).sum(0, np.int64), 255) for c in (x, y))
    return int(np.abs(x - y).sum())


def prefixes(docs: DataFrame, id: str, text: str, k: int, percent: int) -> DataFrame:
    """id, n (shingles), h1, h2 (of the set), cells of the text, and its class counts: v in
    CLASSES classes, and w in a class for FINE shingles or fewer where that is more."""
    kind = dict(docs.dtypes)[id]
    sent = docs.sparkSession.sparkContext.broadcast(rarity(docs, text, k))

    def run(batches):
        level = sent.value
        for batch in batches:
            n, h1, h2, cells, v, w = [], [], [], [], [], []
            for own in shingle_sets(batch.column(1), k):
                size = len(own)
                n.append(size)
                h1.append(int(_signed(np.add.reduce(mix(own ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True))[0]) if size else 0)
                h2.append(int(_signed(np.add.reduce(mix(own * np.uint64(0x2545F4914F6CDD1D)), keepdims=True))[0]) if size else 0)
                v.append(class_counts(own, CLASSES))
                w.append(class_counts(own, 1 << (size // FINE).bit_length()) if size >= FINE * CLASSES else v[-1])
                rare = level[(own & np.uint64(SLOTS - 1)).astype(np.int64)]
                if rare.any():
                    own = own[np.argsort(rare, kind="stable")]
                cells.append(_signed(own[:size - (percent * size + 99) // 100 + 1] if size else own))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                                   pa.array(cells, pa.list_(pa.int64())), pa.array(v, pa.binary()), pa.array(w, pa.binary())],
                                  names=["id", "n", "h1", "h2", "cells", "v", "w"])

    return docs.select(docs[id].alias("id"), docs[text].alias("text")).mapInArrow(
        run, f"id {kind}, n long, h1 long, h2 long, cells array<long>, v binary, w binary")


def shared_cells(cells: DataFrame) -> DataFrame:
    """The rows cell, id, n of cells with two or more rows: one shuffle and one sort, rows
    then stream by, so a cell of any size needs no memory."""

    def run(batches):
        last, told = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch["cell"].to_numpy(zero_copy_only=False)
            same = cell[1:] == cell[:-1]
            joins = last is not None and last["cell"][0].as_py() == int(cell[0])
            keep = np.concatenate(([joins], same)) | np.concatenate((same, [False]))
            if joins and not told:
                yield last
            if keep.any():
                yield batch.filter(pa.array(keep))
            last, told = batch.slice(batch.num_rows - 1), bool(keep[-1])

    kinds = ", ".join(f"{c} {t}" for c, t in cells.dtypes)
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, kinds)


class Measure:
    """Distances of pairs of members, computed only where cheap bounds leave a link open."""

    def __init__(self, docs: DataFrame, members: DataFrame, id: str, text: str, k: int, percent: int):
        self.docs = docs.select(docs[id].alias("id"), docs[text].alias("text"))
        self.members, self.k, self.percent = members.select("id", "n", "v", "w"), k, percent

    def _bounded(self, pairs: DataFrame, counts: str, floor: str = "0D") -> DataFrame:
        """Add low, a lower bound of the distance from sizes and class counts, and open."""
        kind, percent = dict(pairs.dtypes)["a"], self.percent

        def run(batches):
            for batch in batches:
                n = batch["s"].to_numpy(zero_copy_only=False)
                if counts == "v":
                    x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, CLASSES).astype(np.int64) for c in ("x", "y"))
                    apart = np.abs(x - y).sum(1)
                else:
                    apart = np.array([least_apart(x, y) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)], np.int64)
                low = np.maximum(2 * apart / (n + apart), batch["floor"].to_numpy(zero_copy_only=False))
                yield pa.record_batch([batch["a"], batch["b"], pa.array(low), pa.array(100 * (n - apart) >= percent * (n + apart))],
                                      names=["a", "b", "low", "open"])

        own = self.members
        both = pairs.join(own.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col(counts).alias("x")), "a").join(
            own.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col(counts).alias("y")), "b")
        return both.select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("s"), F.expr(floor).alias("floor")).mapInArrow(
            run, f"a {kind}, b {kind}, low double, open boolean")

    def narrow(self, ids: DataFrame) -> None:
        """From now on only texts of these ids are asked for: keep a copy of them, so that
        later rounds do not read all texts again."""
        ids = stored(ids.distinct(), "ids")
        few = ids.limit(IDS_SENT + 1).count() <= IDS_SENT
        self.docs = stored(self.docs.join(F.broadcast(ids) if few else ids, "id", "left_semi"), "texts")

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """The wanted rows (id, rest) with own, the shingle hashes of the id's text."""
        few = wanted.limit(IDS_SENT + 1).count() <= IDS_SENT
        texts = self.docs.join(F.broadcast(wanted) if few else wanted, "id")
        kinds, k = ", ".join(f"{c} {t}" for c, t in wanted.dtypes), self.k

        def run(batches):
            for batch in batches:
                sets, begun, size = [], 0, 0
                for row, own in enumerate(shingle_sets(batch["text"], k), 1):
                    sets.append(_signed(own))
                    size += len(own)
                    # Sets of many long texts at once would not fit a worker.
                    if size > SETS_HELD or row == batch.num_rows:
                        part = batch.slice(begun, len(sets))
                        yield pa.record_batch([*[part[c] for c in wanted_names], pa.array(sets, pa.list_(pa.int64()))], names=[*wanted_names, "own"])
                        sets, begun, size = [], row, 0

        wanted_names = wanted.columns
        return texts.mapInArrow(run, f"{kinds}, own array<long>")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """a, b, low, d (null where a bound was enough) and link of the distinct pairs."""
        coarse = stored(self._bounded(pairs.distinct(), "v"), "pairs")
        # Of long texts that have little in common, coarse counts differ too little to tell.
        fine = self._bounded(coarse.where("open").select("a", "b", "low"), "w", "low")
        bounded = coarse.where("not open").unionByName(stored(fine, "pairs"))
        asked = bounded.where("open")
        left = self._sets(stored(asked.groupBy("a").agg(F.collect_set("b").alias("bs")).withColumnRenamed("a", "id"), "ids"))
        right = self._sets(stored(asked.select(F.col("b").alias("id")).distinct(), "ids"))
        both = left.select(F.col("id").alias("a"), F.explode("bs").alias("b"), F.col("own").alias("x")).join(
            right.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        counted = both.select("a", "b", common.alias("i"), (F.size("x") + F.size("y")).alias("s")).withColumn("u", F.col("s") - F.col("i"))
        # Rows of one id are one document: a link if any of them has one.
        exact = counted.groupBy("a", "b").agg(
            F.min(1 - F.col("i") / F.col("u")).alias("d"), F.max(100 * F.col("i") >= self.percent * F.col("u")).alias("link"))
        return stored(bounded.join(stored(exact, "exact"), ["a", "b"], "left").select(
            "a", "b", F.coalesce("d", "low").alias("low"), "d", F.coalesce("link", F.lit(False)).alias("link")), "distances")


def merged(regions: DataFrame) -> DataFrame:
    """Regions of one pivot and step of sizes as one region, wherever that halves their pairs; from
    rows cell, size, id, n, lack, pivot, pn and m (members of the region).

    Near copies share many cells, with nearly the same members in each. What was compared in
    any of the cells is compared in their union, so no pair is lost; unions of cells that have
    little but the pivot in common would have more pairs and stay apart."""
    each = stored(regions.groupBy("size", "pivot", "id").agg(
        F.first("n").alias("n"), F.first("lack").alias("lack"), F.first("pn").alias("pn"), F.sum("m").alias("w")), "members")
    joint = stored(each.groupBy("size", "pivot").agg(F.count(F.lit(1)).alias("u"), F.sum("w").alias("w")).where("2 * u * u <= w").select("size", "pivot"), "joint")
    # Steps below 0 keep the new regions apart from cells.
    one = each.join(joint, ["size", "pivot"]).select(
        F.xxhash64("pivot").alias("cell"), (-1 - F.col("size")).alias("size"), "id", "n", "lack", "pivot", "pn")
    return one.unionByName(regions.drop("m").join(joint, ["size", "pivot"], "left_anti"))


def labelled(edges: DataFrame) -> DataFrame:
    """id, c: a member that links reach from each id. Two steps: equal labels tell that two are
    connected, others tell nothing; all members around one pivot get one label."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.least("a", F.min("b")).alias("c"))
    return both.join(near.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("c")).withColumnRenamed("a", "id")


def links(docs: DataFrame, members: DataFrame, id: str, text: str, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that connect the same members as all links do; from rows id, n, cells, v."""
    r = 1 - percent / 100 + 1e-9
    measure = Measure(docs, members, id, text, k, percent)
    shared = stored(shared_cells(members.select(F.explode("cells").alias("cell"), "id", F.col("n").cast("int").alias("n"))), "cells")
    release(docs.sparkSession)
    # The text that others were made from shares all its cells, a changed one lacks some; as
    # a pivot it has the others around it.
    has = shared.groupBy("id").agg(F.count(F.lit(1)).alias("has"))
    due = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1
    ranked = stored(shared.join(has, "id").select("cell", "id", "n", (due - F.col("has")).cast("int").alias("lack")), "ranked")
    # Sizes of linked members differ by one step of a scale at most, so each member lies in
    # its own step of its cell and in the next.
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(percent / 100)) + 1e-9).cast("int")
    regions = ranked.select("cell", "id", "n", "lack", F.explode(F.array(step, step + 1)).alias("size"))
    first = regions.groupBy("cell", "size").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("lack", "id", "n")).alias("p")).where("m > 1")
    left = stored(merged(stored(regions.join(first.select("cell", "size", "m", F.col("p.id").alias("pivot"), F.col("p.n").alias("pn")), ["cell", "size"]), "cells")), "regions")
    found, tied, leaf = None, None, LEAF
    even = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")
    while True:
        others = left.where("id <> pivot")
        measured = measure(others.where(even).select(F.col("id").alias("a"), F.col("pivot").alias("b")))
        own = measured.where("link").select("a", "b")
        # Members that links connect already need no link of their own.
        found = own if found is None else found.unionByName(own)
        tied = stored(labelled(found if tied is None else found.unionByName(tied.select(F.col("id").alias("a"), F.col("c").alias("b")))), "labels")
        known = others.join(measured.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "low", "d", "link"), ["id", "pivot"], "left").join(
            tied, "id", "left").withColumns({
            "link": F.coalesce("link", F.lit(False)), "low": F.coalesce("low", 1 - F.least("n", "pn") / F.greatest("n", "pn")), "c": F.coalesce("c", "id")})
        region = known.groupBy("cell", "size").agg(
            F.min(F.when(~F.col("link"), F.col("low"))).alias("least"),
            F.min(F.when(~F.col("link"), F.struct("lack", "id", "n"))).alias("next")).where("least is not null")
        kept = stored(known.join(region, ["cell", "size"]).where(~F.col("link") | (F.col("d") >= F.col("least") - r))
                      .select("cell", "size", "id", "n", "lack", "d", "c", F.col("next.id").alias("pivot"), F.col("next.n").alias("pn")), "kept")
        sizes = stored(kept.groupBy("cell", "size").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("c"), F.max("c").alias("last")).where("c < last").select("cell", "size", "m"), "sizes")
        if leaf == LEAF:
            measure.narrow(kept.join(sizes, ["cell", "size"]).select("id"))
        few = kept.join(sizes.where(F.col("m") <= leaf), ["cell", "size"])
        x, y = few.alias("x"), few.alias("y")
        near = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.id") < F.col("y.id"))
        may = (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & F.coalesce(F.abs(F.col("x.d") - F.col("y.d")) <= r, F.lit(True))
        close = x.join(y, near & may & (F.col("x.c") != F.col("y.c"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        found = found.unionByName(measure(close).where("link").select("a", "b"))
        left = stored(kept.join(sizes.where(F.col("m") > leaf), ["cell", "size"]).select("cell", "size", "id", "n", "lack", "pivot", "pn"), "regions")
        leaf *= 4
        release(docs.sparkSession)
        if left.limit(1).count() == 0:
            return found.distinct()


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row per row: id, n_shingles, component_id (smallest id reachable by links)."""
    every = stored(prefixes(docs, id, text, k, percent), "sets")
    linkable = every.where("n > 0 and id is not null")
    # Equal sets are one member; the others leave before cells are dealt out.
    classes = stored(linkable.groupBy("n", "h1", "h2").agg(F.min("id").alias("id")), "classes")
    copies = stored(linkable.select("id", "n", "h1", "h2").join(classes.withColumnRenamed("id", "first"), ["n", "h1", "h2"]).where(
        "id <> first"), "copies")
    gone = copies.select("id", "n", "h1", "h2").distinct()
    few = gone.limit(IDS_SENT + 1).count() <= IDS_SENT
    members = linkable.join(F.broadcast(gone) if few else gone, ["id", "n", "h1", "h2"], "left_anti")
    near = components(links(docs, members, id, text, k, percent).unionByName(copies.select(F.col("id").alias("a"), F.col("first").alias("b"))))
    rows = every.select("id", "n").join(near.withColumnRenamed("node", "id"), "id", "left").select(
        "id", "n", F.coalesce("component", "id").alias("component"))
    return rows.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows, with all their columns, less those that are linked to a smaller id; of rows
    with the same id all stay or go."""
    joined = join(docs, id, text, k, percent)
    gone = stored(joined.where(F.col(id) > F.col("component_id")).select(F.col(id).alias("_gone")).distinct(), "gone")
    few = gone.limit(IDS_SENT + 1).count() <= IDS_SENT
    return docs.join(F.broadcast(gone) if few else gone, docs[id] == gone["_gone"], "left_anti")
