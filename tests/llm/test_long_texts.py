"""Long texts that share little are told apart by class counts, without their whole sets."""

import random

import numpy as np
import pytest

from panelkit.llm import jaccard

from .test_operators import classes_of


@pytest.mark.parametrize("held", [1 << 20, 1000])
def test_long_texts_with_a_shared_passage(spark, monkeypatch, held):
    rng = random.Random(5)
    passage, rows = [f"p{i}" for i in range(40)], []
    for i in range(12):
        text = [f"w{rng.randrange(10**6)}" for _ in range(8000 + 10 * i)]
        text[100 * i:100 * i] = passage
        rows.append((i, " ".join(text)))
    near = rows[3][1].split()
    near[2000:2300] = [f"n{i}" for i in range(300)]
    rows += [(20, " ".join(near)), (21, rows[4][1]), (22, "")]
    asked, plain = [], jaccard.Measure._sets
    monkeypatch.setattr(jaccard, "SETS_HELD", held, raising=False)
    monkeypatch.setattr(jaccard.Measure, "_sets", lambda self, wanted: asked.append(wanted.count()) or plain(self, wanted))
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in classes_of(rows).items()}
    assert got[20] == 3 and got[21] == 4
    assert 0 < sum(asked) <= 4


def test_class_counts_bound_the_difference():
    rng = np.random.default_rng(3)
    for n, m, shared in [(5, 9, 3), (3000, 3600, 100), (5000, 5000, 4900), (70000, 4000, 4000), (40000, 600, 0)]:
        x, y = (rng.integers(0, 1 << 63, size, dtype=np.int64).astype(np.uint64) for size in (n, m))
        y[:shared] = x[:shared]
        if n == 70000:
            x[:] = (x & np.uint64((1 << 40) - 1)) | np.uint64(7 << 40)  # all in one class
            y[:shared] = x[:shared]
        x, y = np.unique(x), np.unique(y)
        apart = len(np.setxor1d(x, y))
        for p, q in [(128, 128), (1024, 128), (256, 4096), (1 << 14, 1 << 14)]:
            assert jaccard.least_apart(jaccard.class_counts(x, p), jaccard.class_counts(y, q)) <= apart
    # Nearly all of the difference shows where classes are fine.
    x, y = (np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.int64).astype(np.uint64)) for _ in "xy")
    assert jaccard.least_apart(*(jaccard.class_counts(c, 128) for c in (x, y))) < 2000 < 3000 < jaccard.least_apart(*(jaccard.class_counts(c, 2048) for c in (x, y)))
