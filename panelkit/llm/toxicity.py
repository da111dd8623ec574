"""Toxicity by nearest labelled examples: exact TF-IDF cosine, block-max indexes, votes.

1. Up to ``examples`` labelled rows of each label are drawn by hash of their id (a
   documented bound of the fitted model; everything else covers all rows).
2. Character runs of 4 and 5 inside words are counted over the drawn rows in Spark;
   runs that go with label 1 (``least_z`` or more standard errors, and ``least_lift``
   times its share under label 0) become the terms, at most ``terms`` of them.
3. Each example is a TF-IDF vector over the terms. The inverted index keeps, for each
   term, its examples in blocks of fixed ranges with the largest weight of each block;
   examples with the same heaviest term stand together, so few blocks have high sums.
   A query adds up the block maxima, visits blocks by falling sums, and stops where a
   sum falls below its k-th similarity: the neighbours are exact.
4. Votes are weighted by 1 / (distance + 0.05). A logistic curve, fitted to the votes
   of the examples (each without itself) with labels weighted to their real shares,
   makes them probabilities. Texts without any term get the share of label 1 among such
   examples.

The index (bounded by ``examples`` and ``terms``) is sent to every task; texts are
scored whole, where they are read, without a shuffle.

Defined results: a null or empty text has no terms; without labelled rows, or where none
has label 1, the score is 0; rows labelled twice count with their highest label; null
labels do not count; repeated documents each get a row; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+").findall
EXAMPLES, TERMS, LEAST_Z, LEAST_LIFT, NEIGHBOURS, BLOCK = 2_500, 3_000, 5.0, 4.0, 15, 64
CACHED = 50_000  # vectors whose result a worker keeps; when full, all are forgotten


def held_out(id: Column) -> Column:
    return F.pmod(F.crc32(id.cast("string")), F.lit(5)) == 0


def runs_of(text: str) -> set[str]:
    out = set()
    for word in set(LETTERS(text.lower())):
        for n in (4, 5):
            out.update(word[i:i + n] for i in range(len(word) - n + 1))
    return out


class Index:
    """Example vectors in inverted lists by blocks."""

    def __init__(self, terms: list[str], counts: list[dict[int, int]], labels: list[int], ids: list,
                 rows_by_label: tuple[int, int], neighbours: int = NEIGHBOURS):
        self.k = neighbours
        df = Counter(t for c in counts for t in c)
        self.idf = np.array([math.log((1 + len(counts)) / (1 + df[t])) + 1 for t in range(len(terms))])
        self.automaton = None
        if terms:
            self.automaton = ahocorasick.Automaton()
            for i, t in enumerate(terms):
                self.automaton.add_word(t, i)
            self.automaton.make_automaton()
        drawn = [max(1, labels.count(0)), max(1, labels.count(1))]
        # What an example of a label stands for.
        self.weigh = [rows_by_label[y] / drawn[y] for y in (0, 1)]
        empty = [sum(1 for c, y in zip(counts, labels, strict=True) if not c and y == v) for v in (0, 1)]
        mass = [(e + (0.5 if rows_by_label[v] else 0)) * self.weigh[v] for v, e in enumerate(empty)]
        self.without = mass[1] / sum(mass) if sum(mass) else 0.0
        full = [(*self.vector(c), i) for i, c in enumerate(counts) if c]
        full.sort(key=lambda v: (int(v[0][v[1].argmax()]), -float(v[1].max()), v[2]))
        self.ids, self.labels = [ids[i] for *_, i in full], np.array([labels[i] for *_, i in full], int)
        vectors = [v[:2] for v in full]
        self.known: dict[bytes, tuple] = {}
        self.blocks = -(-len(full) // BLOCK)
        lists: list[list[tuple[int, float]]] = [[] for _ in terms]
        for e, (own, weights) in enumerate(vectors):
            for t, w in zip(own.tolist(), weights.tolist(), strict=True):
                lists[t].append((e, w))
        self.examples = [np.array([e for e, _ in x], int) for x in lists]
        self.weights = [np.array([w for _, w in x]) for x in lists]
        self.most = np.zeros((len(terms), self.blocks))
        for t, own in enumerate(self.examples):
            np.maximum.at(self.most[t], own // BLOCK, self.weights[t])
        self.cuts = [np.searchsorted(own, np.arange(self.blocks + 1) * BLOCK) for own in self.examples]
        self.curve = (1.0, 0.0)
        if len(full):
            votes = np.array([self.vote(*v, skip=e) for e, v in enumerate(vectors)])
            self.curve = logistic(logit(votes), self.labels, np.array(self.weigh)[self.labels])

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), int)
        weights = np.array([1 + math.log(counts[t]) for t in terms.tolist()]) * self.idf[terms]
        return terms, weights / np.sqrt((weights * weights).sum())

    def nearest(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1) -> list[tuple[float, int]]:
        """The k nearest examples as (similarity, example), equals by number."""
        sums = weights @ self.most[terms]
        best: list[tuple[float, int]] = []
        for block in np.argsort(-sums, kind="stable").tolist():
            if sums[block] <= 0 or len(best) >= self.k and sums[block] < best[-1][0] - 1e-12:
                break
            likeness = np.zeros(BLOCK)
            for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                a, b = self.cuts[t][block], self.cuts[t][block + 1]
                if a < b:
                    likeness[self.examples[t][a:b] - block * BLOCK] += w * self.weights[t][a:b]
            found = np.flatnonzero(likeness)
            best += [(float(likeness[i]), block * BLOCK + i) for i in found.tolist() if block * BLOCK + i != skip]
            best.sort(key=lambda b: (-b[0], b[1]))
            del best[self.k:]
        return best

    def vote(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1, near=None) -> float:
        near = self.nearest(terms, weights, skip) if near is None else near
        if not near:
            return self.without
        pull = np.array([1 / (1.05 - min(s, 1.0)) for s, _ in near])
        pull *= np.array(self.weigh)[self.labels[[e for _, e in near]]]
        own = float(pull @ self.labels[[e for _, e in near]])
        return (own + self.without) / (float(pull.sum()) + 1)

    def score(self, text: str) -> tuple[float, list, list[float]]:
        """Score, ids of the nearest examples, their similarities."""
        if self.automaton is None or not text:
            return self.without, [], []
        counts = Counter(t for _, t in self.automaton.iter(text.lower()))
        if not counts or not self.blocks:
            return self.without, [], []
        own = self.vector(counts)
        key = own[0].tobytes() + own[1].tobytes()
        if key not in self.known:
            near = self.nearest(*own)
            a, b = self.curve
            value = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * float(logit(np.array([self.vote(*own, near=near)]))[0]) + b))))
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[key] = value, [self.ids[e] for _, e in near], [s for s, _ in near]
        return self.known[key]


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and intercept by Newton steps, drawn to slope 1 and intercept 0."""
    at, design = np.array([1.0, 0.0]), np.stack([x, np.ones(len(x))], 1)
    weight = weight / weight.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        slope = design.T @ (weight * (p - y)) + ridge * len(x) * (at - np.array([1.0, 0.0])) * 0.1
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * len(x) * 0.1 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        at = at - step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(at[0]), 1e-3), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
        examples: int = EXAMPLES, terms: int = TERMS, least_z: float = LEAST_Z, least_lift: float = LEAST_LIFT) -> Index:
    """Learn from labelled rows that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & ~held_out(F.col(id))).groupBy(
        F.col(id).alias("id")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("y"))
    shares = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_hash = [F.xxhash64("id"), F.col("id")]
    drawn = known.where("y = 1").orderBy(*by_hash).limit(examples).unionByName(
        known.where("y = 0").orderBy(*by_hash).limit(examples))
    # At most 2 * examples rows are drawn, so they are sent to the documents.
    texts = docs.select(docs[id].alias("id"), docs[text].alias("text")).join(F.broadcast(drawn), "id").groupBy("id").agg(
        F.max("y").alias("y"), F.coalesce(F.min("text"), F.lit("")).alias("text")).persist()

    def counted(batches):
        tally: Counter = Counter()
        for batch in batches:
            for y, t in zip(batch["y"].to_pylist(), batch["text"].to_pylist(), strict=True):
                tally.update((g, y) for g in runs_of(t))
                if len(tally) > 300_000:
                    yield _tally(tally)
                    tally.clear()
        yield _tally(tally)

    n1 = max(1, min(examples, shares.get(1, 0)))
    n0 = max(1, min(examples, shares.get(0, 0)))
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    joint = (p + n) / (n1 + n0)
    z = (p / n1 - n / n0) / F.sqrt(joint * (1 - joint) * (1 / n1 + 1 / n0))
    runs = texts.select("y", "text").mapInArrow(counted, "run string, y int, n long").groupBy("run").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n"))
    picked = runs.where("p >= 3 and p + n < %d" % (n1 + n0)).withColumn("z", z).where(
        (F.col("z") >= least_z) & (p / n1 >= least_lift * (n + 0.5) / n0)).orderBy(
        F.desc("z"), "run").limit(terms).select("run").collect()
    vocabulary = sorted(r.run for r in picked)
    place = {t: i for i, t in enumerate(vocabulary)}

    def held(batches):
        for batch in batches:
            found = [Counter(_hits(t, place)) for t in batch["text"].to_pylist()]
            yield pa.record_batch({
                "id": batch["id"], "y": batch["y"],
                "term": pa.array([list(c) for c in found], pa.list_(pa.int32())),
                "n": pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))})

    kind = dict(docs.dtypes)[id]
    rows = sorted(texts.select("id", "y", "text").mapInArrow(held, f"id {kind}, y int, term array<int>, n array<int>").collect(), key=lambda r: r.id)
    texts.unpersist()
    return Index(vocabulary, [dict(zip(r.term, r.n, strict=True)) for r in rows], [r.y for r in rows], [r.id for r in rows],
                 (shares.get(0, 0), shares.get(1, 0)))


def _hits(text: str, place: dict[str, int]):
    lower = text.lower()
    for word in LETTERS(lower):
        for n in (4, 5):
            for i in range(len(word) - n + 1):
                if (t := place.get(word[i:i + n])) is not None:
                    yield t


def _tally(tally: Counter) -> pa.RecordBatch:
    return pa.record_batch({"run": pa.array([g for g, _ in tally], pa.string()),
                            "y": pa.array([y for _, y in tally], pa.int32()), "n": pa.array(list(tally.values()), pa.int64())})


def score_frame(docs: DataFrame, index: Index, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: id, score, evidence (ids of the nearest examples), likeness."""
    kind = dict(docs.dtypes)[id]
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = sent.value
        for batch in batches:
            found = [index.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.record_batch([
                batch.column(0), pa.array([f[0] for f in found], pa.float64()),
                pa.array([f[1][:5] for f in found], pa.list_(batch.schema.field(0).type)),
                pa.array([f[2][:5] for f in found], pa.list_(pa.float64()))], names=["id", "score", "evidence", "likeness"])

    return docs.select(docs[id].alias("id"), docs[text].alias("text")).mapInArrow(
        run, f"id {kind}, score double, evidence array<{kind}>, likeness array<double>").withColumnRenamed("id", id)


def clean_rows(docs: DataFrame, index: Index, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores below ``limit``."""
    columns = docs.columns
    place = columns.index(text)
    form = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([sent.value.score(t.as_py() or "")[0] < limit for t in batch.column(place)], pa.bool_()))

    return form.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in form.dtypes)).toDF(*columns)
