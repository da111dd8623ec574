"""Periodic runs of words: stretches that repeat one block of words, found without trying periods.

A run has a smallest period q, at least ``max(6, 4 q)`` words, and no neighbouring word
carries the period on. Per text:

1. Candidate stretches. All words of a run but the first q have the same word at most q
   places before, so a run of period q lies in a stretch of words whose last occurrence is
   at most 2^j >= q places back, plus 2^j words before it. Stretches too short for any run
   are left out, for all powers at once; the rest covers every run in whole, and most texts
   end here.
2. Ukkonen suffix trees of a stretch and of its reversal. An Euler tour that notes the
   string depth at each leaf and between two children turns the lowest common ancestor of
   two leaves into a range minimum, answered in constant time from a sparse table.
3. Lyndon roots. Leaves come in lexicographic order, so the longest Lyndon word at a place
   ends at the next smaller suffix (at the next greater one for the reversed order). Each
   such word is a candidate root; the two trees extend it to the right and to the left, and
   every run is met from one of its roots.

A text is the unit of work, as runs of a text need all of it; trees are built of its
candidate stretches only and take memory in proportion to the longest of them.

Defined results: a null or empty text has no words and no runs and an empty collapsed text;
rows are independent, so repeated ids and rows give a row each; ids may be null; other
columns are kept out; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST, TIMES = 6, 4
FAR = 1 << 40


def _tree(s: list[int], symbols: int):
    """Suffix tree of ``s``, whose last symbol 0 occurs once: edges by node and first
    symbol, and per node its edge's start and end and its suffix (-1 for inner nodes)."""
    n = len(s)
    start, end, link, suffix = [0], [0], [0], [-1]
    edges: dict[int, int] = {}
    find = edges.get
    node, edge, length, left = 0, 0, 0, 0
    for i, c in enumerate(s):
        left += 1
        made = 0
        while left:
            if not length:
                edge = i
            key = node * symbols + s[edge]
            below = find(key)
            if below is None:
                edges[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                suffix.append(i - left + 1)
                if made:
                    link[made] = node
                    made = 0
            else:
                at = start[below]
                wide = end[below] - at
                if length >= wide:
                    edge += wide
                    length -= wide
                    node = below
                    continue
                if s[at + length] == c:
                    length += 1
                    if made:
                        link[made] = node
                    break
                inner = len(start)
                start += (at, i)
                end += (at + length, n)
                link += (0, 0)
                suffix += (-1, i - left + 1)
                edges[key] = inner
                edges[inner * symbols + c] = inner + 1
                at += length
                start[below] = at
                edges[inner * symbols + s[at]] = below
                if made:
                    link[made] = inner
                made = inner
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    return edges, start, end, suffix


class Extension:
    """Longest common extensions of suffixes of a list of positive numbers."""

    def __init__(self, words: list[int], symbols: int):
        s = [*words, 0]
        edges, start, end, suffix = _tree(s, symbols)
        keys = np.fromiter(edges, np.int64, len(edges))
        child = np.fromiter(edges.values(), np.int64, len(edges))
        order = np.argsort(keys)  # by parent, then first symbol
        parent, child = keys[order] // symbols, child[order].tolist()
        first = np.searchsorted(parent, np.arange(len(start) + 1)).tolist()
        self.place = place = [0] * len(s)
        depth, tour, todo = [0] * len(start), [], [0]
        n = len(s)
        while todo:
            x = todo.pop()
            if x < 0:
                tour.append(~x)
                continue
            own = suffix[x]
            if own >= 0:
                place[own] = len(tour)
                tour.append(n - own)
                continue
            d = depth[x]
            for c in reversed(child[first[x]:first[x + 1]]):
                depth[c] = d + end[c] - start[c]
                todo.append(c)
                todo.append(~d)
            todo.pop()
        levels = [np.array(tour, np.int32)]
        wide = 1
        while 2 * wide <= len(tour):
            levels.append(np.minimum(levels[-1][:-wide], levels[-1][wide:]))
            wide *= 2
        self.levels = levels
        self.at = np.array(place)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.at[a], self.at[b]
        low, high = np.minimum(x, y), np.maximum(x, y) + 1
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(x), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            t = self.levels[k]
            out[own] = np.minimum(t[low[own]], t[high[own] - (1 << k)])
        return out


def _ends(place: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix the next one that is smaller, and the next that is greater (or the end)."""
    n = len(place) - 1
    smaller, greater, down, up = [n] * n, [n] * n, [], []
    for i, p in enumerate(place):
        while down and place[down[-1]] > p:
            smaller[down.pop()] = i
        down.append(i)
        if i < n:
            while up and place[up[-1]] < p:
                greater[up.pop()] = i
            up.append(i)
    return smaller, greater


def _runs_within(ids: np.ndarray, least: int, times: int) -> set[tuple[int, int, int]]:
    """start, length, period of the runs of one stretch."""
    n = len(ids)
    _, numbered = np.unique(ids, return_inverse=True)
    words = numbered + 1
    symbols = int(words.max()) + 1
    forward = Extension(words.tolist(), symbols)
    at = np.arange(n)
    starts, periods = [], []
    for ends in _ends(forward.place):
        ends = np.array(ends)
        # A root that a run of so many periods starts with is followed by the same words.
        near = np.flatnonzero(ends < n)
        near = near[words[near] == words[ends[near]]]
        starts.append(at[near])
        periods.append(ends[near] - near)
    start, period = np.concatenate(starts), np.concatenate(periods)
    if not len(start):
        return set()
    right = forward(start, start + period)
    keep = right >= period
    start, period, right = start[keep], period[keep], right[keep]
    # One root of each run is enough: those of a run end together.
    _, one = np.unique(np.stack((start + period + right, period)), axis=1, return_index=True)
    start, period, right = start[one], period[one], right[one]
    if not len(start):
        return set()
    backward = Extension(words[::-1].tolist(), symbols)
    left = np.zeros(len(start), np.int64)
    inner = start > 0
    left[inner] = backward(n - start[inner], n - start[inner] - period[inner])
    length = left + period + right
    keep = length >= np.maximum(least, times * period)
    return set(zip((start - left)[keep].tolist(), length[keep].tolist(), period[keep].tolist()))


def stretches(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """First and last-plus-one of stretches that together hold every run in whole."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    same = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    back = np.full(n, FAR)
    back[order[same + 1]] = order[same + 1] - order[same]
    found, j = [], 0
    while True:
        low, high = (1, 1) if j == 0 else ((1 << j - 1) + 1, 1 << j)
        need = max(least, times * low) - low  # of the least period of this power
        if need + low > n:
            break
        edges = np.flatnonzero(np.diff(back <= high, prepend=False, append=False))
        a, b = edges[::2], edges[1::2]
        for k in np.flatnonzero(b - a >= need).tolist():
            found.append((max(0, int(a[k]) - high), int(b[k])))
        j += 1
    found.sort()
    merged: list[tuple[int, int]] = []
    for a, b in found:
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


def runs_of(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """start, length, period of every run of a list of words, by start, then period."""
    if times < 3:
        raise ValueError("runs need at least three periods")
    names = dict.fromkeys(words)
    # Each run repeats all its words but the first q.
    if len(words) - len(names) < min(least - 1, least - least // times):
        return []
    number = dict(zip(names, count()))
    ids = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
    out: set[tuple[int, int, int]] = set()
    for a, b in stretches(ids, least, times):
        out |= {(a + s, length, q) for s, length, q in _runs_within(ids[a:b], least, times)}
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, of each run only the first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, q in runs:
        kept[start + q:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def find(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """id, n_words, runs (start, length, period by start, then period), collapsed; per row."""
    kind = docs.schema[id].dataType.simpleString()
    part = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ["id", "n_words", "runs", "collapsed"]

    def out(ids, held):
        n, runs, texts = zip(*held, strict=True)
        flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
        offsets = np.cumsum([0, *[len(r) for r in runs]]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(part)))
        return pa.record_batch([ids, pa.array(n, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=names)

    def run(batches):
        for batch in batches:
            held, size, first = [], 0, 0
            for i, value in enumerate(batch["text"]):
                words = value.as_buffer().to_pybytes().split() if value.is_valid else []
                runs = runs_of(words, least, times)
                held.append((len(words), runs, collapsed(words, runs)))
                size += len(held[-1][2])
                if size > 16 << 20:
                    yield out(batch["id"][first:i + 1], held)
                    held, size, first = [], 0, i + 1
            if held:
                yield out(batch["id"][first:], held)

    return docs.select(docs[id].alias("id"), docs[text].alias("text")).mapInArrow(
        run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id)
