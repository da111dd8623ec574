"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, scored from files.

Words. Each word gets a number, small for frequent words: its place by count in its range of
word hashes, times the number of ranges, plus the range. Tables of words lie in files.

Counting. Tasks number the words of whole texts, count the n-grams of a bounded buffer and
send each bucket one packed block. A bucket holds all n-grams with some next-to-last words:
n-grams of every order from 2 on, their contexts and the shorter n-grams inside them agree in
that word, so a bucket counts all orders by itself and hands on only how many words precede
each word. It writes its distinct n-grams once, as packed numbers. A next-to-last word so
frequent that it would fill a bucket (known from the word counts, at most as many as there are
buckets) is spread by the last word; its n-grams are still whole in a bucket, and its contexts,
which are sums over last words, are added up in a table of their own.

Scoring. The n-grams of the texts go to the same buckets, with their rows. A bucket reads its
file once, looks all of them up and hands on a sum of logarithms per row. So each file is
read by one task, whatever the number of texts.

The number of buckets follows the text, so a bucket's arrays keep their size; a lost task
writes the same files again, under a temporary name first. Where the shared folder is not a
mounted one, files are read through its file system instead.

P_k(w | h) = max(c(hw) - D(c), 0) / c(h) + gamma(h) P_{k-1}(w | h'), c being counts at the
highest order and numbers of distinct preceding words below; D as of Chen and Goodman, from
the numbers of n-grams with counts 1 to 4; below order 1 all words and one unknown word are
equally likely. Hashes have 64 bits.

Defined results: a null text is empty; an empty text is one end token; a null id is neither
held out nor left away (it is learned from); repeated rows each count; without learned rows
every word has the same chance; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import io
import math
import os
import uuid
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .stored import release, stored
from .words import block_words, mix, text_blocks

END = np.uint64(0xA24BAED4963EE407)
UNKNOWN, BEGIN, FIRST = 0, 1, 2  # numbers of no known word, of the mark before a text, of the first word
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
BUFFER = 2_000_000  # n-grams counted before blocks are sent
CHARS_PER_BUCKET = 12_000_000
CHARS_PER_RANGE = 64_000_000  # of word hashes
TOKENS_PER_TASK = 20_000_000  # scored by one task, bucket after bucket
ROWS_HELD = 4_000_000  # sums of rows a task holds before it hands them on
FREQUENT = 256  # words of a range that are looked at as possibly too frequent for a bucket


def held_out(id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id.cast("string")), F.lit(7)) == 2, F.lit(False))


# -- files -----------------------------------------------------------------------------

def _local(root: str) -> str | None:
    url = urlparse(root)
    return url.path if url.scheme in ("", "file") else None


def save(root: str, name: str, array: np.ndarray) -> None:
    """Write an array under its final name only when it is whole."""
    data = io.BytesIO()
    np.save(data, array)
    path, spare = _local(root), f"{name}.{uuid.uuid4().hex}"
    if path is not None:
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{spare}", "wb") as file:
            file.write(data.getbuffer())
        os.replace(f"{path}/{spare}", f"{path}/{name}")
    else:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{spare}") as file:
            file.write(data.getvalue())
        system.move(f"{base}/{spare}", f"{base}/{name}")


@lru_cache(maxsize=4096)
def opened(root: str, name: str) -> np.ndarray:
    path = _local(root)
    if path is not None:
        return np.load(f"{path}/{name}", mmap_mode="r") if os.path.getsize(f"{path}/{name}") > 256 else np.load(f"{path}/{name}")
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    with system.open_input_file(f"{base}/{name}") as file:
        return np.load(io.BytesIO(file.read()))


# -- n-grams ---------------------------------------------------------------------------

def joined(words: list[np.ndarray]) -> np.ndarray:
    """Hash of the n-grams whose words stand in the columns; one word is its own hash."""
    out = words[0]
    for w in words[1:]:
        out = mix(out * _STEP + w)
    return out


def parts_of(x: np.ndarray, buckets: int) -> np.ndarray:
    """The range of a hash: 0 to buckets - 1, in order."""
    return ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def among(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x in sorted keys, -1 where absent."""
    if not len(sorted_keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == x, at, -1)


def within(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    return among(sorted_keys, x) >= 0


def buckets_of(words: list[np.ndarray], hot: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of n-grams: by the next-to-last word, and the last one if that is hot."""
    return parts_of(mix(np.where(within(hot, words[-2]), joined(words[-2:]), words[-2]) * _STEP), buckets)


def tokens_of(column: pa.Array):
    """For runs of rows: first row, row after the last, tokens (with an end for each row),
    and where each row's tokens start (with one more entry at the end)."""
    for first, last, data, starts in text_blocks(column):
        words, at = block_words(data, starts)
        rows = last - first
        tokens = np.full(len(words) + rows, END, np.uint64)
        keep = np.ones(len(tokens), bool)
        keep[at[1:] + np.arange(rows)] = False
        tokens[keep] = words
        yield first, last, tokens, at + np.arange(rows + 1)


def columns_of(tokens: np.ndarray, starts: np.ndarray, order: int, begin: int) -> list[np.ndarray]:
    """The words of the n-gram that ends at each token, begin marks before a text."""
    place = np.arange(len(tokens)) - np.repeat(starts[:-1], np.diff(starts))
    out = []
    for back in range(order - 1, 0, -1):
        shifted = np.concatenate((np.full(min(back, len(tokens)), begin, tokens.dtype), tokens[:-back] if back < len(tokens) else tokens[:0]))
        out.append(np.where(place >= back, shifted, begin))
    return [*out, tokens]


def fresh(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)


def summed(words: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct n-grams in the order of their hashes: words, hashes, summed counts."""
    whole = joined(words)
    order = np.argsort(whole)
    whole = whole[order]
    first = fresh(whole)
    sums = np.add.reduceat(counts[order], first) if len(first) else np.empty(0, np.int64)
    return [w[order[first]] for w in words], whole[first], sums


def levels(words: list[np.ndarray], counts: np.ndarray):
    """The distinct n-grams of each order from the highest to 2, as of ``summed``; below the
    highest each distinct longer n-gram is one word that precedes the rest."""
    while True:
        words, whole, counts = summed(words, counts)
        yield words, whole, counts
        if len(words) == 2:
            return
        words, counts = words[1:], np.ones(len(whole), np.int64)


def contexts_of(words: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Contexts of n-grams as sorted hashes; sums of counts and how many are 1, 2 and more."""
    context = joined(words[:-1])
    order = np.argsort(context)
    first = fresh(context[order])
    if not len(first):
        return context, [np.empty(0, np.int64)] * 4
    return context[order[first]], [np.add.reduceat(x[order].astype(np.int64), first) for x in (counts, counts == 1, counts == 2, counts > 2)]


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers from 0, byte by byte of their values, compressed."""
    head, body = [len(columns)], []
    for c in columns:
        width = (int(c.max()).bit_length() + 7) // 8 if len(c) else 0
        head += [len(c), width]
        body.append(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 * (1 + 2 * n), []
    for size, width in np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2).tolist():
        column = np.zeros((size, 8), np.uint8)
        column[:, :width] = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        out.append(column.reshape(-1).view("<u8"))
        at += size * width
    return out


def packed_grams(words: list[np.ndarray], *rest: np.ndarray) -> bytes:
    """N-grams in the order of their next-to-last words, and more columns."""
    return packed([*words[:-2], np.diff(words[-2], prepend=np.zeros(1, words[-2].dtype)), words[-1], *rest])


def unpacked_grams(data: bytes, order: int) -> list[np.ndarray]:
    out = unpacked(data)
    out[order - 2] = np.cumsum(out[order - 2], dtype=np.uint64)
    return out


BLOCK = "kind string, bucket int, block binary, a long, b long, c long, d long, e long"
_NAMES = [x.split()[0] for x in BLOCK.split(", ")]


def _row(kind: str, bucket: int, block: bytes | None, *figures: int) -> pa.RecordBatch:
    values = [*figures, *[0] * (5 - len(figures))]
    return pa.record_batch([pa.array([kind]), pa.array([bucket], pa.int32()), pa.array([block], pa.binary()),
                            *[pa.array([int(v)], pa.int64()) for v in values]], names=_NAMES)


def _rows(kind: str, buckets: list[int], blocks: list[bytes]) -> pa.RecordBatch:
    none = pa.array(np.zeros(len(blocks), np.int64))
    return pa.record_batch([pa.array([kind] * len(blocks)), pa.array(buckets, pa.int32()), pa.array(blocks, pa.binary()), *[none] * 5], names=_NAMES)


def _runs(where: np.ndarray):
    """Value, first and end of each run of equal values."""
    first = fresh(where)
    yield from zip(where[first].tolist(), first.tolist(), [*first[1:].tolist(), len(where)], strict=True)


def _sent(kind: str, buckets: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    order = np.argsort(buckets, kind="stable")
    columns, cuts = [c[order] for c in columns], list(_runs(buckets[order]))
    return _rows(kind, [b for b, _, _ in cuts], [packed([c[i:j] for c in columns]) for _, i, j in cuts])


def _grouped(batches, unpack=unpacked):
    """(bucket, columns of all its blocks) from rows sorted by bucket."""
    bucket, held = None, []
    for batch in batches:
        for own, block in zip(batch["bucket"].to_pylist(), batch["block"].to_pylist(), strict=True):
            if bucket is not None and own != bucket:
                yield bucket, [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            bucket = own
            held.append(unpack(block))
    if held:
        yield bucket, [np.concatenate(c) for c in zip(*held, strict=True)]


def _by_bucket(rows: DataFrame, kind: str, buckets: int) -> DataFrame:
    return rows.where(F.col("kind") == kind).select("bucket", "block").repartition(buckets, "bucket").sortWithinPartitions("bucket")


class Words:
    """The numbered words, in files by range of their hashes."""

    def __init__(self, root: str, ranges: int, present: set[int]):
        self.root, self.ranges, self.present = root, ranges, present

    def _file(self, at: int, name: str) -> np.ndarray:
        return opened(self.root, f"words-{at}-{name}.npy")

    def numbered(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of words in ascending order, 0 for unknown ones."""
        numbers, counts = np.full(len(words), UNKNOWN, np.int64), np.zeros(len(words), np.int64)
        for own, i, j in _runs(parts_of(words, self.ranges)):
            if own in self.present:
                at = among(self._file(own, "keys"), words[i:j])
                hit = at >= 0
                rank = self._file(own, "rank")[at[hit]].astype(np.int64)
                numbers[i:j][hit] = FIRST + rank * self.ranges + own
                counts[i:j][hit] = self._file(own, "count")[rank]
        return numbers, counts

    def before(self, numbers: np.ndarray) -> np.ndarray:
        """How many distinct words precede the words of these numbers; 0 for unknown ones."""
        out = np.zeros(len(numbers), np.int64)
        known = np.flatnonzero(numbers >= FIRST)
        rank, where = np.divmod(numbers[known].astype(np.int64) - FIRST, self.ranges)
        order = np.argsort(where, kind="stable")
        for own, i, j in _runs(where[order]):
            out[known[order[i:j]]] = self._file(own, "before")[rank[order[i:j]]]
        return out


def gathered(tokens: np.ndarray, starts: np.ndarray, order: int, words: Words, hot: np.ndarray, buckets: int):
    """The n-grams of a buffer of texts, as bucket, columns of distinct ones, how often each
    occurs, and the rows where they do, one bucket after the other; and the counts of the tokens."""
    vocabulary, at = np.unique(tokens, return_inverse=True)
    numbers, counts = words.numbered(vocabulary)
    known = np.unique(np.append(numbers, BEGIN))
    columns = columns_of(np.searchsorted(known, numbers)[at], starts, order, int(np.searchsorted(known, BEGIN)))
    row, bits = np.repeat(np.arange(len(starts) - 1), np.diff(starts)), len(known).bit_length()
    sort_by = [columns[-2], *columns[:-2], columns[-1]]
    if bits * order < 64:
        key = sort_by[0]
        for c in sort_by[1:]:
            key = key << bits | c
        sorting = np.argsort(key)
        first = fresh(key[sorting])
    else:
        sorting = np.lexsort(sort_by[::-1])
        first = np.unique(np.concatenate([fresh(c[sorting]) for c in columns]))
    own = [known[c[sorting[first]]].astype(np.uint64) for c in columns]
    times = np.diff(np.append(first, len(sorting)))
    where = narrow(buckets_of(own, hot, buckets))
    grams, places = np.argsort(where, kind="stable"), np.argsort(np.repeat(where, times), kind="stable")
    own, times, row = [c[grams] for c in own], times[grams], row[sorting][places]
    ends = np.append(0, np.cumsum(times))

    def blocks():
        for bucket, i, j in _runs(where[grams]):
            yield bucket, [c[i:j] for c in own], times[i:j], row[ends[i]:ends[j]]

    return blocks(), counts[at]


def buffers(texts, most: int):
    """Runs of whole rows with about so many tokens, from pairs of columns (any, text): the
    first columns of the rows, tokens, and where each row's tokens start."""
    held, size = [], 0
    for other, text in texts:
        for first, last, tokens, starts in tokens_of(text):
            held.append((other.slice(first, last - first), tokens, starts))
            size += len(tokens)
            if size > most:
                yield _buffer(held)
                held, size = [], 0
    if held:
        yield _buffer(held)


def _buffer(held: list):
    others, tokens, starts = zip(*held, strict=True)
    sizes = np.concatenate([np.diff(s) for s in starts])
    return pa.concat_arrays(others), np.concatenate(tokens), np.append(0, np.cumsum(sizes))


class Model:
    """What a worker needs besides the files: figures of the counts."""

    def __init__(self, words: Words, order: int, buckets: int, hot: np.ndarray, tokens: int, types: int):
        self.words, self.order, self.buckets, self.hot = words, order, buckets, hot
        self.tokens, self.types, self.discounts, self.heads = tokens, types, {}, 0
        self.grams: set[int] = set()
        self.contexts: set[int] = set()

    def bucket(self, own: int) -> list[tuple]:
        """Of each order from 2 on: n-grams (sorted hashes), counts; contexts, their figures."""
        empty = np.empty(0, np.uint64)
        columns = unpacked_grams(opened.__wrapped__(self.words.root, f"grams-{own}.npy").tobytes(), self.order) if own in self.grams else [empty] * (self.order + 1)
        out = [(whole, counts, *contexts_of(words, counts)) for words, whole, counts in levels(columns[:-1], columns[-1].astype(np.int64))]
        return out[::-1]

    def _contexts(self, keys: np.ndarray) -> list[np.ndarray]:
        """Figures of contexts that end with a hot word, by sorted hashes; 0 where absent."""
        out = [np.zeros(len(keys), np.int64) for _ in range(4)]
        for own, i, j in _runs(parts_of(keys, self.words.ranges)):
            if own in self.contexts:
                at = among(opened(self.words.root, f"contexts-{own}-keys.npy"), keys[i:j])
                hit = at >= 0
                for x, name in zip(out, CONTEXT, strict=True):
                    x[i:j][hit] = opened(self.words.root, f"contexts-{own}-{name}.npy")[at[hit]]
        return out

    def chances(self, words: list[np.ndarray], tables: list[tuple]) -> np.ndarray:
        """Chances of the last words of n-grams of one bucket, as log10."""
        last, at = np.unique(words[-1], return_inverse=True)
        d, uniform = self.discounts[1], 1 / (self.types + 1)
        if self.heads:
            before = self.words.before(last)
            less = np.array([0.0, *d[:3]])[np.minimum(before, 3)]
            chance = np.maximum(before - less, 0) / self.heads + d[3] / self.heads * uniform
        else:
            chance = np.full(len(last), uniform)
        chance, hot = chance[at], within(self.hot, words[-2])
        for k, (grams, counts, contexts, figures) in enumerate(tables, 2):
            own, d = words[self.order - k:], self.discounts[k]
            at = among(grams, joined(own))
            seen = np.where(at >= 0, counts[at], 0) if len(grams) else np.zeros(len(at), np.int64)
            context = joined(own[:-1])
            at = among(contexts, context)
            total, one, two, more = (np.where(at >= 0, x[at], 0) for x in figures) if len(contexts) else np.zeros((4, len(at)), np.int64)
            if hot.any():
                keys, at = np.unique(wide(context[hot], k), return_inverse=True)
                for x, y in zip((total, one, two, more), self._contexts(keys), strict=True):
                    x[hot] = y[at]
            less = np.array([0.0, *d[:3]])[np.minimum(seen, 3)]
            safe = np.maximum(total, 1)
            chance = np.where(total > 0, np.maximum(seen - less, 0) / safe + (d[0] * one + d[1] * two + d[2] * more) / safe * chance, chance)
        return np.log10(chance)


CONTEXT = ("total", "one", "two", "more")


def wide(contexts: np.ndarray, k: int) -> np.ndarray:
    """Hashes of contexts of one order, told apart from those of other orders."""
    return mix(contexts + np.uint64(k) * _STEP)


def discounts_of(n: tuple[int, int, int, int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more, from the numbers of n-grams with counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not (n1 and n2):
        return (0.5, 0.75, 0.75)
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2)
    return tuple(min(max(x, 0.01), k + 0.99) for k, x in enumerate(d))


def train(texts: DataFrame, order: int = 2, root: str | None = None) -> Model:
    """Count a model from a string column named ``text`` (null: empty)."""
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark = texts.sparkSession
    root = root or scratch_path(spark, "ngrams")
    texts = texts.select("text")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, math.ceil(chars / CHARS_PER_BUCKET))
    ranges = max(min(partitions, 64), math.ceil(chars / CHARS_PER_RANGE))

    def count_words(batches):
        for _, tokens, _ in buffers(((b.column(0), b.column(0)) for b in batches), BUFFER):
            own, n = np.unique(tokens, return_counts=True)
            yield _sent("words", parts_of(own, ranges), [own, n])

    def add_words(batches):
        for own, (keys, counts) in _grouped(batches):
            _, keys, counts = summed([keys], counts.astype(np.int64))
            order_ = np.argsort(-counts, kind="stable")
            rank = np.empty(len(keys), np.int64)
            rank[order_] = np.arange(len(keys))
            save(root, f"words-{own}-keys.npy", keys)
            save(root, f"words-{own}-rank.npy", narrow(rank))
            save(root, f"words-{own}-count.npy", narrow(counts[order_]))
            yield _row("figures", own, packed([counts[order_[:FREQUENT]]]), counts.sum(), len(keys))

    found = stored(_by_bucket(texts.mapInArrow(count_words, BLOCK), "words", ranges).mapInArrow(add_words, BLOCK), "words").select(
        "bucket", "block", "a", "b").collect()  # a row for each range
    tokens, types = sum(r.a for r in found), sum(r.b for r in found)
    words = Words(root, ranges, {r.bucket for r in found})
    # Words that would fill a bucket; the mark before texts as well.
    hot = [np.array([BEGIN])]
    for r in found:
        often = np.flatnonzero(unpacked(r.block)[0] > tokens / buckets)
        hot.append(FIRST + often * ranges + r.bucket)
    model = Model(words, order, buckets, np.sort(np.concatenate(hot)).astype(np.uint64), tokens, types)
    hot = model.hot

    def count_grams(batches):
        for _, tokens, starts in buffers(((b.column(0), b.column(0)) for b in batches), BUFFER):
            blocks, _ = gathered(tokens, starts, order, words, hot, buckets)
            sent = [(bucket, packed_grams(own, times)) for bucket, own, times, _ in blocks]
            yield _rows("grams", [x for x, _ in sent], [x for _, x in sent])

    def add_grams(batches):
        for bucket, columns in _grouped(batches, lambda block: unpacked_grams(block, order)):
            own, counts = columns[:-1], columns[-1].astype(np.int64)
            del columns
            for own, _, counts in levels(own, counts):
                k = len(own)
                if k == order:
                    by = np.argsort(own[-2], kind="stable")
                    save(root, f"grams-{bucket}.npy", np.frombuffer(packed_grams([w[by] for w in own], counts[by]), np.uint8))
                    yield _row("written", bucket, None)
                yield _row(f"figures{k}", bucket, None, *[(counts == c).sum() for c in (1, 2, 3, 4)])
                at = within(hot, own[-2])
                if at.any():
                    keys, figures = contexts_of([w[at] for w in own], counts[at])
                    keys = wide(keys, k)
                    yield _sent("contexts", parts_of(keys, ranges), [keys, *figures])
            # Each distinct pair is one word that precedes its last word.
            last, before = np.unique(own[-1].astype(np.int64), return_counts=True)
            rank, where = np.divmod(last - FIRST, ranges)
            yield _sent("before", where, [rank, before])

    added = stored(_by_bucket(texts.mapInArrow(count_grams, BLOCK), "grams", buckets).mapInArrow(add_grams, BLOCK), "grams")
    release(spark)
    sums = {r.kind: r for r in added.where("kind like 'figures%'").groupBy("kind").agg(*[F.sum(c).alias(c) for c in "abcd"]).collect()}
    for k in range(order, 1, -1):
        n = sums.get(f"figures{k}")
        model.discounts[k] = discounts_of((n.a, n.b, n.c, n.d) if n else (0, 0, 0, 0))
    model.grams = {r.bucket for r in added.where("kind = 'written'").select("bucket").collect()}

    def add_contexts(batches):
        for own, (keys, *figures) in _grouped(batches):
            order_ = np.argsort(keys)
            first = fresh(keys[order_])
            save(root, f"contexts-{own}-keys.npy", keys[order_[first]])
            for name, c in zip(CONTEXT, figures, strict=True):
                save(root, f"contexts-{own}-{name}.npy", narrow(np.add.reduceat(c[order_].astype(np.int64), first)))
            yield _row("written", own, None)

    model.contexts = {r.bucket for r in stored(_by_bucket(added, "contexts", ranges).mapInArrow(add_contexts, BLOCK), "contexts").select("bucket").collect()}

    def add_before(batches):
        for own, (rank, before) in _grouped(batches):
            # Every learned word has a word or a mark before it.
            all_before = np.bincount(rank.astype(np.int64), before, len(opened(root, f"words-{own}-count.npy"))).astype(np.int64)
            save(root, f"words-{own}-before.npy", narrow(all_before))
            yield _row("figures", own, None, *[(all_before == c).sum() for c in (1, 2, 3, 4)], all_before.sum())
            yield _row("more", own, None, (all_before > 2).sum())

    last = stored(_by_bucket(added, "before", ranges).mapInArrow(add_before, BLOCK), "before")
    n = [x or 0 for x in last.where("kind = 'figures'").agg(*[F.sum(c) for c in "abcde"]).first()]
    more = last.where("kind = 'more'").agg(F.sum("a")).first()[0] or 0
    d = discounts_of(tuple(n[:4]))
    # With the mass that is taken from all words together.
    model.discounts[1], model.heads = (*d, d[0] * n[0] + d[1] * n[1] + d[2] * more), n[4]
    release(spark)
    return model


def score_frame(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: id, n_tokens, n_known, base_score, score (log10)."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id]
    sent = spark.sparkContext.broadcast(model)
    # bucket -1: the rows of a buffer; else n-grams of a bucket, or sums of rows (count: tokens).
    form = f"bucket int, buffer long, count long, block binary, ids array<{kind}>"
    names = [x.split()[0] for x in form.split(", ")]

    def made(bucket: list, buffer: list, count: list, block: list, ids: pa.Array):
        return pa.record_batch([pa.array(bucket, pa.int32()), pa.array(buffer, pa.int64()), pa.array(count, pa.int64()), pa.array(block, pa.binary()), ids], names=names)

    def count_grams(batches):
        model, part = sent.value, TaskContext.get().partitionId()
        for k, (ids, tokens, starts) in enumerate(buffers(((b.column(0), b.column(1)) for b in batches), BUFFER)):
            blocks, counts = gathered(tokens, starts, model.order, model.words, model.hot, model.buckets)
            base = np.log10((counts + 1) / (model.tokens + model.types + 1))
            sizes, rows, buffer = np.diff(starts), len(ids), part << 32 | k
            known = np.add.reduceat((counts > 0).astype(np.int64), starts[:-1])
            yield made([-1], [buffer], [rows], [sizes.tobytes() + known.tobytes() + np.add.reduceat(base, starts[:-1]).tobytes()],
                       pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), ids))
            own = [(bucket, packed_grams(grams, times, row)) for bucket, grams, times, row in blocks]
            yield made([x for x, _ in own], [buffer] * len(own), [rows] * len(own), [x for _, x in own], pa.nulls(len(own), pa.list_(ids.type)))

    def score(batches):
        model, order = sent.value, sent.value.order
        bucket, tables, held, size, sums, tokens = None, None, [], 0, {}, {}

        def settle():
            words = [np.concatenate([block[c] for _, _, block in held]) for c in range(order)]
            _, first, at = np.unique(joined(words), return_index=True, return_inverse=True)
            chance, begun = model.chances([w[first] for w in words], tables)[at], 0
            for buffer, rows, block in held:
                own = np.repeat(chance[begun:begun + len(block[0])], block[-2].astype(np.int64))
                begun += len(block[0])
                if buffer not in sums:
                    sums[buffer], tokens[buffer] = np.zeros(rows), 0
                sums[buffer] += np.bincount(block[-1].astype(np.int64), own, rows)
                tokens[buffer] += len(own)

        def handed_on():
            return made([0] * len(sums), list(sums), [tokens[b] for b in sums], [x.tobytes() for x in sums.values()], pa.nulls(len(sums), ids_type))

        ids_type = None
        for batch in batches:
            ids_type = batch["ids"].type
            whole = np.flatnonzero(batch["bucket"].to_numpy(zero_copy_only=False) == -1)
            if len(whole):
                yield batch.take(pa.array(whole))
            for own, buffer, rows, block in zip(*[batch[c].to_pylist() for c in names[:4]], strict=True):
                if own == -1:
                    continue
                if held and (own != bucket or size > BUFFER):
                    settle()
                    held, size = [], 0
                    if sum(len(x) for x in sums.values()) > ROWS_HELD:
                        yield handed_on()
                        sums.clear()
                        tokens.clear()
                if own != bucket:
                    bucket, tables = own, model.bucket(own)
                held.append((buffer, rows, unpacked_grams(block, order)))
                size += len(held[-1][2][-1])
        if held:
            settle()
        if sums:
            yield handed_on()

    def added(batches):
        buffer, rows, held, tokens = None, None, [], 0

        def whole():
            count, block, ids = rows
            sizes, known = np.frombuffer(block, np.int64, 2 * count).reshape(2, count)
            if tokens != sizes.sum():
                raise ValueError("a task was repeated and read its rows in another order")
            return pa.record_batch([ids, *[pa.array(x) for x in (sizes, known, np.frombuffer(block, np.float64, count, 16 * count), sum(held))]],
                                   names=["id", "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            for i, (own, at, count, block) in enumerate(zip(*[batch[c].to_pylist() for c in names[:4]], strict=True)):
                if buffer is not None and at != buffer:
                    yield whole()
                    rows, held, tokens = None, [], 0
                buffer = at
                if own == -1:
                    rows = count, block, batch["ids"][i].values
                else:
                    held.append(np.frombuffer(block, np.float64))
                    tokens += count
        if buffer is not None:
            yield whole()

    parallel = spark.sparkContext.defaultParallelism
    tasks = min(model.buckets, max(4 * parallel, math.ceil(model.tokens / TOKENS_PER_TASK)))
    rows = docs.select(docs[id].alias("id"), docs[text].alias("text")).mapInArrow(count_grams, form)
    # Rows of buffers need no bucket, so they are spread by buffer.
    rows = rows.repartition(tasks, F.when(F.col("bucket") < 0, -1 - F.col("buffer") % (1 << 20)).otherwise(F.col("bucket"))).sortWithinPartitions("bucket", "buffer")
    return rows.mapInArrow(score, form).repartition(2 * parallel, "buffer").sortWithinPartitions("buffer").mapInArrow(
        added, f"id {kind}, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("id", id)
