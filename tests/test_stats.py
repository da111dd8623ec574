"""Statistics against published values and independent formulas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from panelkit.functions import scales
from panelkit.stats import corr, dist, moments, predictors, reliability, rm_anova, ttests


@pytest.mark.parametrize("t,df,p", [(2.228, 10, 0.05), (12.706, 1, 0.05), (1.96, 1e7, 0.05), (2.704, 40, 0.01), (0, 5, 1)])
def test_t_table(t, df, p):
    assert dist.t_tail(t, df) == pytest.approx(p, abs=2e-5)


@pytest.mark.parametrize("f,a,b,p", [(4.10, 2, 10, 0.05), (3.84, 1, 1e6, 0.05), (5.994, 4, 10, 0.01)])
def test_f_table(f, a, b, p):
    assert dist.f_tail(f, a, b) == pytest.approx(p, abs=1e-4)


def test_f_is_t_squared():
    assert dist.f_tail(2.3**2, 1, 17) == pytest.approx(float(dist.t_tail(2.3, 17)), abs=1e-14)


def wide(spark, n=60, missing=True):
    rng = np.random.default_rng(7)
    base = rng.normal(size=n)
    pdf = pd.DataFrame({
        "id": range(n), "y0": base + rng.normal(size=n), "y1": base + 0.5 + rng.normal(size=n),
        "y2": base * 0.5 + rng.normal(size=n), "x": rng.normal(size=n), "g": np.where(rng.random(n) < 0.4, "m", "f"),
    })
    if missing:
        pdf.loc[3, "y2"] = None
    return spark.createDataFrame(pdf), pdf


def test_two_waves_equal_paired_t(spark):
    df, _ = wide(spark, missing=False)
    t = ttests.paired(df, [("y1", "y0")]).collect()[0]
    f = rm_anova.rm_ancova(df, ["y0", "y1"], {}).where("term = 'time'").collect()[0]
    assert f.f == pytest.approx(t.t**2, rel=1e-10)
    assert f.p == pytest.approx(t.p, rel=1e-8)
    assert (f.df1, f.df2) == (1.0, 59.0)


def test_rm_ancova_equals_refits_and_subgroup_runs(spark):
    df, pdf = wide(spark)
    out = rm_anova.rm_ancova(df, ["y0", "y1", "y2"], {"g": ["f", "m"], "x": None}).toPandas().set_index("term")
    full = pdf.dropna()
    g = np.where(full.g == "f", 1.0, -1.0)
    x = np.column_stack([np.ones(len(full)), g, full.x, g * full.x])
    z = full[["y0", "y1", "y2"]].to_numpy() @ rm_anova.contrasts(3)

    def rss(cols):
        b = np.linalg.lstsq(x[:, cols], z, rcond=None)[0]
        return ((z - x[:, cols] @ b) ** 2).sum()

    left = len(full) - 4
    for term, drop in (("time", 0), ("g:time", 1), ("x:time", 2), ("g:x:time", 3)):
        rest = [c for c in range(4) if c != drop]
        f = ((rss(rest) - rss(range(4))) / 2) / (rss(range(4)) / (2 * left))
        assert out.loc[term, "f"] == pytest.approx(f, rel=1e-9)
    assert 0.5 <= out.loc["time", "epsilon"] <= 1
    by = rm_anova.rm_ancova(df, ["y0", "y1", "y2"], {"x": None}, by=["g"]).where("g = 'm'").toPandas().set_index("term")
    alone = rm_anova.rm_ancova(df.where("g = 'm'"), ["y0", "y1", "y2"], {"x": None}).toPandas().set_index("term")
    assert np.allclose(by.loc[alone.index, "f"], alone["f"])


def regression_frame(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)) * [1, 3, 10, 0.5, 2]
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=400)
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(5)])
    pdf["y"], pdf["key"] = y, np.arange(400)
    return spark.createDataFrame(pdf), [f"x{i}" for i in range(5)]


def test_elastic_net_equals_spark_ml(spark):
    df, xs = regression_frame(spark)
    path = predictors.elastic_net_path(df, xs, ["y"], length=100).toPandas()
    rows = VectorAssembler(inputCols=xs, outputCol="features").transform(df)
    for step in (5, 20, 40):
        mine = path[path.step == step].set_index("predictor")
        lam = float(mine["lambda"].iloc[0])
        sd = df.agg(F.stddev_pop("y")).first()[0] / df.agg(F.stddev_samp("y")).first()[0]
        theirs = LinearRegression(labelCol="y", elasticNetParam=0.5, regParam=lam / sd, tol=1e-12, maxIter=1000).fit(rows)
        assert np.allclose(mine.loc[xs, "beta"], theirs.coefficients.toArray(), atol=0.02)


def test_nested_models_equal_least_squares(spark):
    df, xs = regression_frame(spark)
    models = predictors.choose_predictors(df, "key", xs, ["y"], length=200).toPandas().sort_values("row")
    assert list(models.predictor[:2]) == ["x0", "x1"]
    pdf = df.toPandas()
    for _, m in models.iterrows():
        use = list(models.predictor[: m["row"]])
        x = np.column_stack([np.ones(400), pdf[use]])
        rss = ((pdf.y - x @ np.linalg.lstsq(x, pdf.y, rcond=None)[0]) ** 2).sum()
        bic = 400 * np.log(2 * np.pi) + 400 * np.log(rss / 400) + 400 + np.log(400) * (len(use) + 2)
        assert m.bic == pytest.approx(bic, rel=1e-10)
    best = models.loc[models.bic.idxmin(), "row"]
    assert set(models.predictor[models["row"] <= best]) >= {"x0", "x1"}


def test_pairwise_correlations_and_screen(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(300, 4)), columns=list("abcd"))
    pdf["b"] += pdf["a"]
    pdf = pdf.mask(rng.random(pdf.shape) < 0.1)
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in "abcd"])
    want = pdf.corr()
    for row in moments.pairwise_correlations(df, list("abcd")).collect():
        assert row.r == pytest.approx(want.loc[row.x, row.y], abs=1e-12)
    screen = corr.factor_screen(df, list("abcd")).orderBy("k").toPandas()
    assert np.allclose(screen.eigenvalue, np.sort(np.linalg.eigvalsh(pdf.dropna().corr()))[::-1])


def test_alpha(spark):
    pdf = pd.DataFrame([[1, 2, 3, 3], [2, 2, 4, 3], [3, 4, 4, 5], [4, 4, 5, 5], [5, 5, 5, None], [2, 3, 3, 2]], columns=list("abcd"), dtype=float)
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in "abcd"])
    total = pdf.dropna().sum(axis=1)
    want = 4 / 3 * (1 - pdf.var().sum() / total.var())
    assert reliability.cronbach_alpha(df, list("abcd")).first().alpha == pytest.approx(want)


def test_train_split_ignores_partitioning(spark):
    df = spark.range(1000)
    a = df.where(predictors.train_flag("id")).count()
    b = df.repartition(7).where(predictors.train_flag("id")).count()
    assert a == b and 700 < a < 800


def test_scale_battery_without_gaps_is_a_plain_sum(spark):
    names = [f"AS01_{i:02d}" for i in range(1, 19)]
    df = spark.createDataFrame([tuple(range(1, 19))], ", ".join(f"{n} int" for n in names))
    row = scales.score(df).first()
    assert row.asi3 == sum(range(18)) and row.asi3_phys == sum(v - 1 for v in (3, 4, 7, 8, 12, 15))
