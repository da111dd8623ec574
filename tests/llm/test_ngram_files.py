"""The n-gram model over many buckets: same scores, a file for each bucket, hot words spread."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest

from panelkit.llm import kneser


@pytest.mark.parametrize("order", [2, 3, 4])
def test_many_buckets_score_as_few(spark, monkeypatch, order):
    rng = random.Random(order)
    vocabulary = [f"v{i}" for i in range(300)]
    # One word is every third one, so its n-grams would fill buckets.
    texts = [" ".join(x for w in rng.choices(vocabulary, k=rng.randrange(0, 30)) for x in ([w, "the"] if rng.random() < 0.5 else [w])) for _ in range(150)]
    rows = [*enumerate(texts), (None, "the v1 the new"), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    learned = docs.where("doc_id % 3 > 0").select("text")
    by = lambda model: sorted(((r.doc_id is None, r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in kneser.score_frame(docs, model).collect()), key=str)
    want = by(kneser.train(learned, order))
    monkeypatch.setattr(kneser, "CHARS_PER_BUCKET", 200)
    monkeypatch.setattr(kneser, "BUFFER", 300)
    monkeypatch.setattr(kneser, "ROWS_HELD", 10, raising=False)
    model = kneser.train(learned, order)
    assert model.buckets > 40 and len(model.hot) > 1
    files = os.listdir(model.words.root.removeprefix("file://"))
    assert len(files) <= model.buckets + 9 * model.words.ranges
    got = by(model)
    assert len(got) == len(want) == 153
    for x, y in zip(got, want, strict=True):
        assert x[:4] == y[:4] and math.isclose(x[4], y[4], rel_tol=1e-9) and math.isclose(x[5], y[5], rel_tol=1e-9)


class Numbered:
    def numbered(self, words):
        return words.astype(np.int64), np.ones(len(words), np.int64)


@pytest.mark.parametrize("order, buckets", [(2, 1), (3, 5), (3, 400), (12, 5)])
def test_grams_of_a_buffer(order, buckets):
    rng = np.random.default_rng(order)
    sizes = rng.integers(1, 30, 60)
    starts = np.append(0, np.cumsum(sizes))
    tokens = rng.integers(kneser.FIRST, 50, starts[-1]).astype(np.uint64)
    hot = np.array([kneser.BEGIN, 7, 8], np.uint64)
    want, got = Counter(), Counter()
    for row, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        x = [kneser.BEGIN] * (order - 1) + tokens[a:b].tolist()
        want.update((row, *x[i:i + order]) for i in range(b - a))
    places = {}
    for bucket, words, times, rows in kneser.gathered(tokens, starts, order, Numbered(), hot, buckets)[0]:
        *words, times, rows = kneser.unpacked_grams(kneser.packed_grams(words, times, rows), order)
        at = 0
        for n, *gram in zip(times.tolist(), *[w.tolist() for w in words], strict=True):
            got.update((r, *gram) for r in rows[at:at + n].tolist())
            at += n
            same = tuple(gram[-2:]) if gram[-2] in hot else gram[-2]
            assert places.setdefault(same, bucket) == bucket
    assert got == want
