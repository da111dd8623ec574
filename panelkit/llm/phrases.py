"""Phrase collocations by a three-way quicksort of suffixes, routed by their leading words.

A suffix is a place in a piece of text; only its first ``depth`` = 3 words count. Rounds:

1. Words are counted per language (tasks pre-count). A word below ``least`` occurrences can
   be in no candidate; a bitmap of fixed size tells tasks which hashes may be frequent, and
   the others end their piece there.
2. Tasks sort their suffixes, count equal ones and send each run of different suffixes to a
   route, packed as hashes. Routes are ranges of the global order by first, second, third
   word, cut at quantiles of a bounded sample, so the suffixes of a hot leading word or pair
   are dealt over as many routes as they fill; the sample shapes routes, never results.
3. Each route is sorted by multikey three-way quicksort: a partition is split by one word
   into smaller, equal and greater, equal ones go on to the next word. The weight of an
   equal partition is the count of that phrase; a partition below ``least`` is abandoned,
   unless it lies at the route's border, where phrases may go on in the next route: those
   parts are summed and judged afterwards. Small partitions are finished by one plain sort.

Words are 64-bit keyed hashes of language and word. The table of counted words tells whether
two of them share a hash; then everything is done again under another key, so counts are exact.

Defined results: a null text is empty, a null language is ``und``; repeated rows and ids
count as often as they occur; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

LEAST, TOP, SHADOWED = 10, 2_000, 50
DEPTH = 3
BITS = 26
TOKENS, NAMES, ROUTE, SMALL = 1_500_000, 1 << 17, 1_500_000, 1_024
SAMPLE_TEXTS, SAMPLE_EACH = 4_000, 50

_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)


class _Names(dict):
    """Numbers of the words of one language, given out when first met."""

    def __init__(self, lang: str, key: tuple[int, int], hashes: list[int]):
        super().__init__({b"": -1, b"\n": 0})
        seed, self.size = key
        self.key, self.hashes = hashlib.blake2b(f"{seed}|{lang}".encode(), digest_size=32).digest(), hashes

    def __missing__(self, word: bytes) -> int:
        # 0 stands for the end of a piece.
        self.hashes.append(int.from_bytes(hashlib.blake2b(word, digest_size=self.size, key=self.key).digest(), "little") or 1)
        self[word] = number = len(self.hashes) - 1
        return number


class Tokens:
    """Words of texts as numbers, 0 at the ends of pieces."""

    def __init__(self, key: tuple[int, int]):
        self.key = key
        self.reset()

    def reset(self) -> None:
        self.hashes, self.names, self.parts, self.size = [0], {}, [], 0

    def add(self, lang: str, text: bytes) -> None:
        names = self.names.get(lang)
        if names is None:
            names = self.names[lang] = _Names(lang, self.key, self.hashes)
        words = (text + b"\n").translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        own = np.fromiter(map(names.__getitem__, words), np.int32, len(words))
        own = own[own >= 0]
        self.parts.append(own)
        self.size += len(own)

    def full(self) -> bool:
        return self.size >= TOKENS or len(self.hashes) >= NAMES

    def taken(self) -> np.ndarray:
        return np.concatenate(self.parts)


def _filled(batches, key: tuple[int, int]):
    """Tokens of the rows (lang, text), yielded whenever they are many, then emptied."""
    tokens = Tokens(key)
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            tokens.add(lang, text.as_buffer().to_pybytes())
            if tokens.full():
                yield tokens
                tokens.reset()
    if tokens.parts:
        yield tokens


def _own(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(docs[lang], F.lit("und")).alias("lang"), docs[text].alias("text")).where("text IS NOT NULL")


def word_counts(texts: DataFrame, key: tuple[int, int]) -> DataFrame:
    """h, lang, word, n of every word of every language."""

    def run(batches):
        for tokens in _filled(batches, key):
            counts = np.bincount(tokens.taken(), minlength=len(tokens.hashes))
            hashes = np.array(tokens.hashes, np.uint64).view(np.int64)
            for lang, names in tokens.names.items():
                words = [w for w, i in names.items() if i > 0]
                ids = np.array([i for i in names.values() if i > 0], np.int64)
                for at in range(0, len(words), 50_000):
                    part = ids[at:at + 50_000]
                    yield pa.record_batch([pa.array(hashes[part]), pa.array([lang] * len(part)), pa.array(words[at:at + 50_000], pa.binary()).cast(pa.string()),
                                           pa.array(counts[part])], names=["h", "lang", "word", "n"])

    return texts.mapInArrow(run, "h long, lang string, word string, n long").groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


def _bitmap(frequent: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value of the first bits of a frequent word's hash: 2^bits / 64 numbers."""
    slot = F.shiftrightunsigned("h", 64 - bits)
    rows = frequent.groupBy(F.shiftrightunsigned(slot, 6).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _suffixes(tokens: Tokens, bitmap: np.ndarray, bits: int):
    """Numbers of the first three words of each suffix of two words or more, and hashes by number."""
    hashes = np.array(tokens.hashes, np.uint64)
    slot = hashes >> np.uint64(64 - bits)
    known = (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
    known[0] = False
    a = np.where(known, np.arange(len(hashes), dtype=np.int32), 0)[tokens.taken()]
    a = np.append(a, np.zeros(2, a.dtype))
    at = np.flatnonzero((a[:-2] > 0) & (a[1:-1] > 0))
    return a[at], a[at + 1], a[at + 2], hashes


class _Order:
    """Suffixes of a task as one number each, in the order of their hashes."""

    def __init__(self, hashes: np.ndarray):
        self.sorted, self.wide = np.sort(hashes), len(hashes)  # 0 first
        self.rank = np.empty(self.wide, np.int64)
        self.rank[np.argsort(hashes)] = np.arange(self.wide)

    def pack(self, x, y, z) -> np.ndarray:
        self.pairs, pair = np.unique(self.rank[x] * self.wide + self.rank[y], return_inverse=True)
        return pair * self.wide + self.rank[z]

    def hashes(self, packed: np.ndarray) -> list[np.ndarray]:
        pair = self.pairs[packed // self.wide]
        return [self.sorted[n] for n in (pair // self.wide, pair % self.wide, packed % self.wide)]

    def bounds(self, cuts: np.ndarray) -> np.ndarray:
        """The least packed number that is not before each cut (rows of three hashes)."""

        def step(names, wanted, same):
            at = np.searchsorted(names, wanted)
            return at, same & (names[np.minimum(at, len(names) - 1)] == wanted)

        if not len(self.pairs):
            return np.zeros(len(cuts), np.int64)
        one, same = step(self.sorted, cuts[:, 0], np.ones(len(cuts), bool))
        two, both = step(self.sorted, cuts[:, 1], same)
        pair, both = step(self.pairs, one * self.wide + np.where(same, two, 0), both)
        three, _ = step(self.sorted, cuts[:, 2], both)
        return pair * self.wide + np.where(both, three, 0)


def _pack_rows(h: list[np.ndarray], count: np.ndarray) -> bytes:
    first, runs = np.unique(h[0], return_counts=True)
    sizes = np.array([len(count), len(first)], np.int64)
    raw = b"".join([sizes.tobytes(), first.tobytes(), runs.astype(np.int32).tobytes(), h[1].tobytes(), h[2].tobytes(), count.astype(np.int32).tobytes()])
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack_rows(data: bytes) -> tuple[np.ndarray, ...]:
    raw = pa.decompress(data[8:], decompressed_size=int(np.frombuffer(data[:8], np.int64)[0]), codec="zstd", asbytes=True)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    first = np.frombuffer(raw, np.uint64, m, 16)
    at = 16 + 8 * m
    runs = np.frombuffer(raw, np.int32, m, at)
    at += 4 * m
    return np.repeat(first, runs), np.frombuffer(raw, np.uint64, n, at), np.frombuffer(raw, np.uint64, n, at + 8 * n), np.frombuffer(raw, np.int32, n, at + 16 * n)


def _cuts(texts: DataFrame, rows: int, tokens: int, key: tuple[int, int], bitmap: np.ndarray, bits: int, route: int) -> np.ndarray:
    """Ascending borders between routes, each three hashes."""
    routes = -(-tokens // route)
    if routes <= 1:
        return np.zeros((0, DEPTH), np.uint64)

    def run(batches):
        rng = np.random.default_rng(5)
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                own = Tokens(key)
                own.add(lang, text.as_buffer().to_pybytes())
                *numbers, hashes = _suffixes(own, bitmap, bits)
                if len(numbers[0]):
                    drawn = rng.integers(len(numbers[0]), size=min(SAMPLE_EACH, len(numbers[0])))
                    # Long texts stand for more suffixes than are drawn.
                    weight = np.full(len(drawn), len(numbers[0]) / len(drawn))
                    yield pa.record_batch([*[pa.array(hashes[x[drawn]].view(np.int64)) for x in numbers], pa.array(weight)], names=["a", "b", "c", "weight"])

    share = min(1.0, SAMPLE_TEXTS / max(rows, 1))
    drawn = texts.where(F.rand(3) < share).limit(2 * SAMPLE_TEXTS).mapInArrow(run, "a long, b long, c long, weight double").toArrow()
    if not drawn.num_rows:
        return np.zeros((0, DEPTH), np.uint64)
    keys = np.stack([drawn[c].to_numpy().view(np.uint64) for c in "abc"], 1)
    order = np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))
    upto = np.cumsum(drawn["weight"].to_numpy()[order])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, routes) / routes)
    return np.unique(keys[order[np.minimum(at, len(order) - 1)]], axis=0)


def _routed(texts: DataFrame, key: tuple[int, int], bitmap: np.ndarray, bits: int, cuts: np.ndarray) -> DataFrame:
    """route, rows (packed): different suffixes with their counts, per task and route."""

    def run(batches):
        for tokens in _filled(batches, key):
            x, y, z, hashes = _suffixes(tokens, bitmap, bits)
            order = _Order(hashes)
            packed, count = np.unique(order.pack(x, y, z), return_counts=True)
            edges = [0, *np.searchsorted(packed, order.bounds(cuts)).tolist(), len(packed)]
            for route, (a, b) in enumerate(zip(edges, edges[1:])):
                if a < b:
                    data = _pack_rows(order.hashes(packed[a:b]), count[a:b])
                    yield pa.record_batch([pa.array([route], pa.int32()), pa.array([data], pa.binary())], names=["route", "rows"])

    return texts.mapInArrow(run, "route int, rows binary")


def three_way(words: list[np.ndarray], weight: np.ndarray, least: int, small: int = SMALL):
    """Yield (first words, weights) of phrases of two and more words that weigh at least
    ``least``, and of lighter ones that touch the first or last row in sorted order."""
    n, depth_most = len(weight), len(words)
    order = np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        low, high, depth = todo.pop()
        border = low == 0 or high == n
        own = order[low:high]
        if not border and weight[own].sum() < least:
            continue  # abandoned
        if len(own) <= small:
            sub = own[np.lexsort([words[d][own] for d in range(depth_most - 1, depth - 1, -1)])]
            change = np.zeros(len(sub), bool)
            change[0] = True
            for d in range(depth, depth_most):
                change[1:] |= words[d][sub[1:]] != words[d][sub[:-1]]
                at = np.flatnonzero(change)
                total = np.add.reduceat(weight[sub], at)
                keep = total >= least
                if low == 0:
                    keep[0] = True
                if high == n:
                    keep[-1] = True
                keep &= words[d][sub[at]] != 0
                if d and keep.any():
                    yield [w[sub[at[keep]]] for w in words[:d + 1]], total[keep]
            continue
        value = words[depth][own]
        a, b, c = value[0], value[len(value) // 2], value[-1]
        pivot = max(min(a, b), min(max(a, b), c))
        less, equal, more = own[value < pivot], own[value == pivot], own[value > pivot]
        order[low:high] = np.concatenate((less, equal, more))
        one, two = low + len(less), high - len(more)
        if len(less):
            todo.append((low, one, depth))
        if len(more):
            todo.append((two, high, depth))
        if pivot != 0:
            total = weight[equal].sum()
            if total >= least or one == 0 or two == n:
                if depth:
                    yield [w[equal[:1]] for w in words[:depth + 1]], np.array([total])
                if depth + 1 < depth_most:
                    todo.append((one, two, depth + 1))


def _phrase_counts(routed: DataFrame, routes: int, least: int) -> DataFrame:
    """h1, h2, h3 (0 for phrases of two words), a: counts of frequent phrases."""

    def sort(held):
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        found, size = [], 0
        for words, total in three_way(columns[:DEPTH], columns[DEPTH].astype(np.int64), least):
            words += [np.zeros(len(total), np.uint64)] * (DEPTH - len(words))
            found.append([*words, total])
            size += len(total)
            if size > 100_000:
                yield batch_of(found)
                found, size = [], 0
        if found:
            yield batch_of(found)

    def batch_of(found):
        parts = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.record_batch([*[pa.array(p.view(np.int64)) for p in parts[:DEPTH]], pa.array(parts[DEPTH])], names=["h1", "h2", "h3", "a"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for route, data in zip(batch["route"].to_pylist(), batch["rows"], strict=True):
                if route != now and held:
                    yield from sort(held)
                    held = []
                now = route
                held.append(_unpack_rows(data.as_buffer().to_pybytes()))
        if held:
            yield from sort(held)

    parts = routed.repartition(routes, "route").sortWithinPartitions("route").mapInArrow(run, "h1 long, h2 long, h3 long, a long")
    return parts.groupBy("h1", "h2", "h3").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shadowed: int = SHADOWED, lang: str = "lang", text: str = "text",
                 bits: int = BITS, route: int = ROUTE, hash_bytes: int = 8) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: per language its ``top`` best phrases.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut, ``n`` all
    words of the language. A phrase is left out if a longer one that holds it is at least
    ``shadowed`` percent as frequent."""
    texts = _own(docs, lang, text)
    key = (0, hash_bytes)
    while True:
        words = stored(word_counts(texts, key), "words")
        if words.groupBy("h").count().where("count > 1").isEmpty():
            break
        key = (key[0] + 1, hash_bytes)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    total = words.agg(F.sum("n")).first()[0] or 0
    bitmap = _bitmap(frequent, bits)
    cuts = _cuts(texts, texts.count() if total > route else 0, total, key, bitmap, bits, route)
    counts = stored(_phrase_counts(_routed(texts, key, bitmap, bits, cuts), len(cuts) + 1, least), "phrases")

    f1 = frequent.select("h", "lang", "word", F.col("n").alias("f"))
    part = lambda i, f=f1: f.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"))
    pairs, triples = counts.where("h3 = 0").drop("h3"), counts.where("h3 <> 0")
    # The most frequent longer phrase over each pair.
    over = triples.select(F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("p"), "a").groupBy(
        F.col("p.h1").alias("h1"), F.col("p.h2").alias("h2")).agg(F.max("a").alias("over"))
    two = pairs.join(over, ["h1", "h2"], "left").where(F.col("over").isNull() | (100 * F.col("over") < shadowed * F.col("a"))).join(
        f1.select(F.col("h").alias("h1"), "lang", F.col("word").alias("w1"), F.col("f").alias("f1")), "h1").join(part(2), "h2").select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.array(F.struct(F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f2").alias("r"))).alias("cuts"))
    front = pairs.select("h1", "h2", F.col("a").alias("f12"))
    back = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23"))
    three = triples.join(front, ["h1", "h2"]).join(back, ["h2", "h3"]).join(
        f1.select(F.col("h").alias("h1"), "lang", F.col("word").alias("w1"), F.col("f").alias("f1")), "h1").join(part(2), "h2").join(part(3), "h3").select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.array(
            F.struct(F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f23").alias("r")),
            F.struct(F.lit(2).alias("k"), F.col("f12").alias("l"), F.col("f3").alias("r"))).alias("cuts"))
    # Counts up to 10^15 keep every product within 38 digits.
    exact = "cast(%s AS DECIMAL(15,0))"
    score = f"(1000000 * {exact % 'a'} * {exact % 'a'}) div ({exact % 'x.l'} * {exact % 'x.r'})"
    cut = F.array_min(F.expr(f"transform(cuts, x -> struct({score} AS score, x.k AS k, x.l AS l, x.r AS r))"))
    scored = two.unionByName(three).withColumn("cut", cut).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part first, so that no task holds a language.
    few = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("place") <= top).drop("part", "place")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")
    return few.withColumn("rank", rank).where(F.col("rank") <= top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
