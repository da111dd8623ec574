"""Factor counts against numpy, on items that three known factors make."""

import numpy as np
import pandas as pd
import pytest

from panelkit.stats import factors

COLS = [f"x{j}" for j in range(12)]


@pytest.fixture(scope="module")
def items():
    rng = np.random.default_rng(2)
    f = rng.normal(size=(900, 3))
    return np.column_stack([(2.0, 1.2, 0.8)[j % 3] * f[:, j % 3] + rng.normal(size=900) for j in range(12)])


def eigen(x):
    return np.linalg.eigvalsh(np.corrcoef(x.T))[::-1]


def test_rules_against_numpy(spark, items):
    df = spark.createDataFrame(pd.DataFrame(items, columns=COLS))
    rules = factors.scree_rules(df, COLS, replicates=60).orderBy("k").toPandas()
    e = eigen(items)
    assert np.allclose(rules.eigenvalue, e)
    assert np.allclose(rules.acceleration[1:-1], np.diff(e, 2))
    predicted = [np.polyval(np.polyfit([i + 1, 12], [e[i], e[-1]], 1), i) for i in range(1, 11)]
    assert np.allclose(rules.predicted[:10], predicted) and rules.predicted[10:].isna().all()
    rng = np.random.default_rng(9)
    want = np.quantile([eigen(rng.permuted(items, axis=0)) for _ in range(200)], 0.95, axis=0)
    assert np.abs(rules.parallel - want).max() < 0.05
    counts = factors.factor_counts(spark.createDataFrame(rules)).first()
    assert (counts.n_items, counts.n_kaiser, counts.n_parallel, counts.n_optimal, counts.n_elbow) == (12, 3, 3, 3, np.diff(e, 2).argmax() + 1)


def test_shuffles_do_not_depend_on_partitions_and_break_correlation(spark, items):
    pdf = pd.DataFrame(items, columns=COLS).sort_values("x0")  # rows that lie together are alike
    runs = [factors.shuffled_eigenvalues(spark.createDataFrame(pdf).repartition(n), COLS, replicates=5, block_rows=100).toPandas() for n in (1, 7)]
    one, two = (r.sort_values(["replicate", "k"]).eigenvalue.to_numpy() for r in runs)
    assert np.allclose(one, two) and len(one) == 60
    # The three factors are gone.
    assert one.max() < 1.6 < eigen(items)[2]


def test_degenerate_items(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x0": rng.normal(size=50), "x1": rng.normal(size=50), "x2": 3.0})
    rules = factors.scree_rules(spark.createDataFrame(pdf), ["x0", "x1", "x2"], replicates=10).orderBy("k").toPandas()
    assert rules.eigenvalue.notna().tolist() == [True, True, False] and rules.parallel.notna().tolist() == [True, True, False]
    counts = factors.factor_counts(factors.scree_rules(spark.createDataFrame(pdf), ["x0", "x1", "x2"], replicates=10)).first()
    assert counts.n_items == 2
    none = spark.createDataFrame([], "x0 double, x1 double")
    assert factors.scree_rules(none, ["x0", "x1"], replicates=3).where("eigenvalue IS NOT NULL").count() == 0
