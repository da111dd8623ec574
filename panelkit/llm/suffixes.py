"""Removal of repeated byte strings by minimizer anchors and string fingerprints.

Not prefix doubling, which sorts positions by pairs of ranks at growing offsets and, run
over every byte, moves all positions several times. Two fixed rounds start where equal
strings must meet:

1. Of each ``length``-byte window the ``gram``-byte string with the smallest hash is its
   anchor (equal windows have equal anchors at equal places, whatever surrounds them);
   windows next to each other with one anchor form a run. Runs are sorted by the rank of
   their anchor string. A rank that occurs once ends here: all its windows are unique.
2. In the same sort, the rank of the whole run is the second key: all windows of a run
   that was seen before are repeats. What stays open are first runs that share their
   anchor with a different run (the borders of shared passages).
3. The windows of open runs are sorted by the pair of ranks of their two halves (offset
   ``length`` / 2), with the anchor's rank before it; all but the first are repeats. Equal
   windows have equal anchors, so anchors are dealt into parts that are sorted in turn.

Ranks are 64-bit fingerprints of the strings, always compared in pairs with a second one.
Sorted rows stream through tasks, so a string of any frequency needs the memory of a
batch; a text of one repeated character has an anchor at every byte and is slow, not wrong.

Defined results: a null text counts as empty and an empty one has nothing removed; texts
below ``length`` bytes neither lose nor cause anything; rows whose ids repeat or are null
are put in order by id (null last), then text, and each counts as a document of its own; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import release, stored
from .words import STEP, mix

LENGTH, GRAM = 100, 32
# The second round takes the anchors in so many parts, one after the other, as its windows
# are the largest table of all.
PARTS = 2


class Text:
    """Fingerprints of the strings of one text.

    Those of strings of 2^k bytes are made of two of half the length, up from eight bytes
    that are taken as they are; another length is covered by two strings that overlap.
    """

    def __init__(self, data: bytes):
        self.n = len(data)
        self.data = np.frombuffer(data, np.uint8)
        self.held: dict[int, np.ndarray] = {}

    def level(self, k: int) -> np.ndarray:
        """Of the strings of 2^k bytes at every place."""
        below = max((j for j in self.held if j <= k), default=None)
        if below is None:
            below = min(k, 3)
            value = self.data.astype(np.uint64)
            for j in range(below):
                value = value[:-(1 << j)] | value[1 << j:] << np.uint64(8 << j)
            value = mix(value ^ STEP)
        else:
            value = self.held[below]
        for j in range(below, k):
            value = value[:-(1 << j)] * STEP + value[1 << j:]
            value ^= value >> np.uint64(32)
        self.held[k] = value
        return value

    def ranks(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = ends - starts
        out = sizes.astype(np.uint64) * STEP
        levels = np.frexp(sizes.astype(np.float64))[1] - 1
        for k in np.unique(levels).tolist():
            own, of = levels == k, self.level(k)
            out[own] += mix(of[starts[own]]) ^ of[ends[own] - (1 << k)]
        return mix(out)

    def runs(self, length: int, gram: int):
        """Anchor, first and last window of each run."""
        k = gram.bit_length() - 1
        value = self.level(k)
        if gram > 1 << k:
            value = value[:-(gram - (1 << k))] * STEP ^ value[gram - (1 << k):]
        least = (mix(value) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(value), dtype=np.uint64)
        wide, have = length - gram + 1, 1
        while have * 2 <= wide:
            least, have = np.minimum(least[:-have], least[have:]), have * 2
        if have < wide:
            least = np.minimum(least[:len(least) - (wide - have)], least[wide - have:])
        anchors = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        turn = np.flatnonzero(np.diff(anchors)) + 1
        first = np.concatenate(([0], turn))
        last = np.concatenate((turn - 1, [len(anchors) - 1]))
        return anchors[first], first, last


def _rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor_rank, run_rank, doc, place of every run; place packs its first window, the
    anchor's distance from it and the number of further windows."""

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for doc, text in zip(batch["doc"].to_pylist(), batch["text"], strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(data) < length:
                    continue
                own = Text(data)
                anchor, first, last = own.runs(length, gram)
                held.append((own.ranks(anchor, anchor + gram), own.ranks(first, last + length) ^ mix((anchor - first).astype(np.uint64)),
                             np.full(len(first), doc, np.int64), first << 14 | (anchor - first) << 7 | (last - first)))
                size += len(first)
                if size > 200_000:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    return texts.mapInArrow(run, "a long, b long, doc long, place long")


def _batch(held: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*held, strict=True)], names=["a", "b", "doc", "place"])


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]


def _first_round(rows: DataFrame) -> DataFrame:
    """doc, first, last, rank (of the anchor; 0 for repeats) and whether the run is open or a repeat."""

    def out(doc, place, a, is_open):
        first = place >> 14
        return pa.record_batch([pa.array(doc), pa.array(first), pa.array(first + (place & 127)), pa.array(a if is_open else np.zeros(len(a), np.int64)),
                                pa.array(np.full(len(doc), is_open))], names=["doc", "first", "last", "rank", "open"])

    def run(batches):
        # The anchor and run of the row before; the first row of its anchor, if that may yet open.
        seen_a = seen_b = None
        waits = None
        for batch in batches:
            a, b, doc, place = _columns(batch)
            n = len(a)
            if n == 0:
                continue
            new_a, new_b = np.empty(n, bool), np.empty(n, bool)
            new_a[0] = seen_a is None or a[0] != seen_a
            new_b[0] = new_a[0] or b[0] != seen_b
            new_a[1:] = a[1:] != a[:-1]
            new_b[1:] = new_a[1:] | (b[1:] != b[:-1])
            if not new_b.all():
                r = ~new_b
                yield out(doc[r], place[r], a[r], False)
            at = np.flatnonzero(new_b)
            if len(at):
                again = ~new_a[at]  # another run of the same anchor
                opens = again.copy()
                opens[:-1] |= again[1:]
                if again[0] and waits is not None:
                    yield out(*waits, True)
                    waits = None
                if opens.any():
                    o = at[opens]
                    yield out(doc[o], place[o], a[o], True)
                if new_a[at[-1]]:
                    k = at[-1:]
                    waits = (doc[k].copy(), place[k].copy(), a[k].copy())
                elif new_a[at].any():
                    waits = None
            seen_a, seen_b = a[-1], b[-1]

    return rows.repartition("a").sortWithinPartitions("a", "b", "doc", "place").mapInArrow(
        run, "doc long, first long, last long, rank long, open boolean")


def _windows(texts: DataFrame, open_runs: DataFrame, length: int) -> DataFrame:
    """a (anchor rank), b (pair of half ranks), doc, place of the windows of open runs."""
    runs = open_runs.groupBy("doc").agg(F.collect_list(F.struct("first", "last", "rank")).alias("runs"))
    half = length // 2

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for doc, text, own_runs in zip(batch["doc"].to_pylist(), batch["text"], batch["runs"], strict=True):
                parts = own_runs.values
                first, last, rank = (parts.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                own = Text(text.as_buffer().to_pybytes())
                count = last - first + 1
                starts = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                pair = mix(own.ranks(starts, starts + half) + mix(own.ranks(starts + half, starts + length)))
                held.append((np.repeat(rank, count).view(np.uint64), pair, np.full(len(starts), doc, np.int64), starts))
                size += len(starts)
                if size > 200_000:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    return texts.join(runs, "doc").mapInArrow(run, "a long, b long, doc long, place long")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as sorted intervals apart from each other."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[fresh], reach[np.concatenate((fresh[1:], [True]))]


def _second_round(windows: DataFrame, length: int) -> DataFrame:
    """doc, first, last: stretches of windows that occurred before."""

    def out(held):
        doc, place = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)))
        ends = np.concatenate((fresh[1:], [True]))
        return pa.record_batch([pa.array(doc[fresh]), pa.array(place[fresh]), pa.array(place[ends])], names=["doc", "first", "last"])

    def run(batches):
        seen, held, size = None, [], 0
        for batch in batches:
            a, b, doc, place = _columns(batch)
            if not len(a):
                continue
            again = np.empty(len(a), bool)
            again[0] = seen == (a[0], b[0])
            again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            seen = (a[-1], b[-1])
            if again.any():
                held.append((doc[again], place[again]))
                size += int(again.sum())
            if size > 1_000_000:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    return windows.repartition("a", "b").sortWithinPartitions("a", "b", "doc", "place").mapInArrow(run, "doc long, first long, last long")


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc, first, last: stretches of windows of ``length`` bytes that also start earlier;
    from rows doc (distinct), text."""
    if not 8 <= gram <= length - 1 or length - gram + 1 > 127:
        raise ValueError("the gram must leave at most 127 places in the length")
    spark = texts.sparkSession
    runs = stored(_first_round(_rows(texts, length, gram)), "runs", by=("open",))
    release(spark)
    found = runs.where("not open").select("doc", "first", "last")
    for part in range(PARTS):
        own = runs.where(F.col("open") & (F.pmod("rank", F.lit(PARTS)) == part))
        found = found.unionByName(stored(_second_round(_windows(texts, own, length), length), "windows"))
        release(spark)
    return found


def _ordered(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, doc (distinct, in the order that decides what is earlier), text."""
    own = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    counts = own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.max(F.col("id").isNull().cast("int")).alias("z")).first()
    if (counts.n or 0) <= 1 and not counts.z and dict(own.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint"):
        return own.select("id", F.col("id").cast("long").alias("doc"), "text")
    spark, kind = docs.sparkSession, own.schema["id"].dataType.simpleString()
    ranked = own.orderBy(F.col("id").asc_nulls_last(), F.col("text").asc_nulls_first()).rdd.zipWithIndex().map(lambda x: (x[0][0], x[1], x[0][1]))
    return stored(spark.createDataFrame(ranked, f"id {kind}, doc long, text string"), "ordered")


def cleaned(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
            keep_bytes: bool = False) -> DataFrame:
    """One row per row: id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_bytes``
    also kept, the bytes that stay."""
    texts = _ordered(docs, id, text)
    found = repeats(texts.select("doc", "text"), length, gram)
    by_doc = found.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    kind = dict(docs.dtypes)[id]

    def run(batches):
        for batch in batches:
            rows = []
            for text, runs in zip(batch["text"], batch["runs"], strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                removed = spans = 0
                kept = data
                if runs.is_valid:
                    first, last = (runs.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                    starts, ends = merged(first, last + length)
                    removed, spans = int((ends - starts).sum()), len(starts)
                    edges = [0, *np.stack((starts, ends), 1).ravel().tolist(), len(data)]
                    kept = b"".join(data[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2))
                rows.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            n, r, s, h, k = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.record_batch([batch["id"], pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()),
                                   pa.array(h, pa.string()), pa.array(k, pa.binary())],
                                  names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = texts.join(by_doc, "doc", "left").select("id", "text", "runs").mapInArrow(
        run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id)
    return out if keep_bytes else out.drop("kept")
