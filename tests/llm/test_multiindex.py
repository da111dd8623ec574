"""The inverted multi-index against brute force: exact when all cells are walked, recall otherwise."""

import numpy as np
import pytest

from panelkit.llm import multiindex
from panelkit.session import load

ROWS = "vec_id long, embedding array<double>, label int, gid long, cell int, ids string"


def brute(rows, k=5):
    usable = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    usable = [(i, np.ldexp(v, -np.frexp(np.abs(v).max())[1])) for i, v in usable]
    out = []
    for a, (i, v) in enumerate(usable):
        if i is None or i % 50:
            continue
        near = sorted((-(v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum())), j is None, j or 0)
                      for b, (j, w) in enumerate(usable) if a != b and len(v) == len(w))
        out += [(i, r + 1, None if no_id else j, round(-s, 9)) for r, (s, no_id, j) in enumerate(near[:k])]
    return sorted(out, key=repr)


def found(df, **options):
    return sorted(((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in multiindex.search(df, **options).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 10))
    x[:300] = x[0]  # a third of the table is one vector
    x[300:320] = x[300] + rng.normal(size=(20, 10)) * 1e-3
    own = [(i, v.tolist()) for i, v in enumerate(x)]
    return own + [(100, own[100][1]), (None, own[7][1]), (None, own[500][1]), (50, [1.0, 2.0]), (51, [2.0, 4.0]), (52, [-2.0, -4.0]),
                  (150, [0.0] * 10), (200, [float("nan")] * 10), (250, None), (300, []), (350, [1.0, float("inf")]), (400, [None] * 10), (450, [-0.0, 1e-200]), (500, [0.0, 1e200])]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, 8, "x") for i, v in rows], ROWS)


@pytest.mark.parametrize("block", [2048, 50])
def test_exact_when_all_cells_are_walked(table, rows, block):
    assert found(table, recall=1.0, block=block) == brute(rows)


def test_recall_and_scores(spark):
    sf_dir = "/root/testdata/sf0.01"
    table = load(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want, got = brute(rows), found(table)
    assert len(got) == len(want)
    nearest = {(q, v): s for q, _, v, s in want}
    hits = [(q, v) for q, _, v, _ in got if (q, v) in nearest]
    assert len(hits) >= 0.9 * len(want)
    assert all(nearest[q, v] == s for q, _, v, s in got if (q, v) in nearest)


def test_walk_is_in_order_and_stops():
    rng = np.random.default_rng(1)
    grid = multiindex.Grid(6, rng.normal(size=(400, 6)), 400, 8)
    cells = grid.cells(multiindex.unit(rng.normal(size=(400, 6))))
    names, sizes = np.unique(cells, return_counts=True)
    grid.lay(names, sizes, 0, 20)
    one, two = (d[0] for d in grid.distances(multiindex.unit(rng.normal(size=(1, 6)))))
    total = (one[:, None] + two[None]).ravel()
    assert [round(total[c], 12) for c in grid.walk(one, two, 400)] == sorted(round(total[c], 12) for c in names)
    few = grid.walk(one, two, 30)
    assert grid.size[few].sum() >= 30 > grid.size[few[:-1]].sum()
    # Blocks hold at most so many entries; a larger cell has blocks of its own.
    for block in np.unique(grid.first[names]):
        held = [c for c in names if grid.first[c] == block]
        assert len(held) == 1 or grid.size[held].sum() <= 20


def test_empty_and_few(spark, table):
    assert multiindex.search(table.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id, r.score) for r in multiindex.search(few).collect()] == [(1, 1, 1.0), (2, 2, 0.0)]
