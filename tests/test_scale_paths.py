"""Paths meant for large or skewed groups, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit.operators import linkage, matching, plotdata, reshape
from panelkit.operators import quantiles as quantile_steps
from panelkit.operators.quantiles import quantiles
from panelkit.sources import readers, writers
from panelkit.stats import corr, dist, rm_anova


def test_quantiles_by_counting(spark):
    rng = np.random.default_rng(3)
    hot = np.concatenate([np.full(4000, 1.5), rng.lognormal(0, 8, 3000), -rng.lognormal(0, 4, 999)])
    pdf = pd.DataFrame({"g": ["hot"] * len(hot) + ["one"] + ["none"] * 2, "x": [*hot, 7.0, None, None]})
    df = spark.createDataFrame(pdf, "g string, x double")
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.g: r for r in quantiles(df, "x", probs, ["g"]).collect()}
    assert np.allclose(got["hot"].q, np.quantile(hot, probs), rtol=1e-12)
    assert got["one"].q == [7.0] * 5
    assert got["none"].n == 0 and got["none"].q is None
    whole = quantiles(df, "x", probs).collect()[0]
    assert np.allclose(whole.q, np.quantile([*hot, 7.0], probs), rtol=1e-12)


def test_order_code_sorts_as_the_values(spark):
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 2047 << 52, 20_000)
    powers = 2.0 ** np.arange(-1074, 1024)
    x = np.concatenate([bits.view(float), powers, np.nextafter(powers, np.inf), np.nextafter(powers, 0), rng.normal(size=5000), [0.0, np.inf]])
    x = np.concatenate([x, -x])
    got = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = quantile_steps.with_code(got, "x", "c").toPandas()
    size = np.abs(got.x.to_numpy()).view(np.int64)
    assert (got.c == np.where(got.x < 0, -size, size)).all()


def test_quantiles_do_not_depend_on_the_size_of_a_group(spark):
    rng = np.random.default_rng(6)
    x = [0.1, 0.7, *rng.normal(size=37).tolist(), float("-inf"), float("inf")]
    rows = [(g, v, 0) for g in ("one", "two") for v in x] + [("inf", float("-inf"), 0), ("inf", 1.0, 0), ("tenths", 0.1, 0), ("tenths", 0.7, 0)]
    # The same values beside a group a thousand times as large.
    rows += [("large", float(v), 0) for v in rng.normal(size=40_000)]
    df = spark.createDataFrame(rows, "g string, x double, k int")
    probs = [0.0, 0.3, 0.5, 0.77, 1.0]
    got = {r.g: list(r.q) for r in quantiles(df, "x", probs, ["g"]).collect()}
    alone = {g: list(quantiles(df.where(F.col("g") == g), "x", probs).first().q) for g in ("one", "inf", "tenths", "large")}
    assert all(got[g] == q for g, q in alone.items()) and got["one"] == got["two"]
    assert got["inf"] == [float("-inf")] * 4 + [1.0]
    large = np.sort([r[1] for r in rows if r[0] == "large"])
    h = 39_999 * np.array(probs)
    low, high, w = large[np.floor(h).astype(int)], large[np.ceil(h).astype(int)], h - np.floor(h)
    assert got["large"] == [a if a == b or c == 0 else a * (1 - c) + b * c for a, b, c in zip(low, high, w)]


def brute_links(new, old, parts):
    out = {}
    for n in new:
        scores = [(sum(n[p] is not None and n[p] == o[p] for p in parts), o["key"]) for o in old]
        top = max((s for s, _ in scores), default=0)
        hits = sorted(k for s, k in scores if s == top) if top else []
        out[n["key"]] = (top, hits)
    return out


def test_linkage_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    parts = ["a", "b", "yyyy", "mm", "dd"]

    def people(tag, n):
        return [
            {"key": f"{tag}{i}", **{p: (None if rng.random() < 0.08 else "hot" if rng.random() < 0.4 else str(rng.integers(0, 6))) for p in parts}}
            for i in range(n)
        ]

    new, old = people("n", 80), people("o", 120)
    new[0].update(dict.fromkeys(parts))  # nothing typed
    schema = "key string, " + ", ".join(f"{p} string" for p in parts)
    n_df, o_df = spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)
    best = linkage.best_candidates(n_df, o_df, "key", parts)
    want = brute_links(new, old, parts)
    for row in best.collect():
        top, hits = want[row.new]
        assert (row.concordance, row.n_candidates) == (top, len(hits))
        assert row.old == (hits[0] if len(hits) == 1 else None)
    pairs = {(r.new, r.old) for r in linkage.candidate_pairs(n_df, o_df, "key", parts, best).collect()}
    assert pairs == {(n, o) for n, (_, hits) in want.items() for o in hits}


def test_decisions_are_applied_by_key(spark):
    new = spark.createDataFrame([("n1", 1), ("n2", 2), ("n3", 3)], "ref string, case int")
    old = spark.createDataFrame([("o1", 12), ("o2", 34), ("o3", 5)], "ref string, case int")
    decisions = spark.createDataFrame(
        [("n3", "o3", 4, "auto match", None, "+"), ("n1", "o1", 5, "doppelt 12 34", "12", "?"), ("n2", "o2", 3, "", None, "-")],
        "new string, old string, concordance int, comment string, comment2 string, decision string",
    )
    replaced, kept = linkage.apply_decisions(new, old, decisions, "ref", "case")
    assert sorted(map(tuple, replaced.collect())) == [("n2", 2), ("o1", 1), ("o3", 3)]
    assert sorted(r.case for r in kept.collect()) == [5, 12]


def brute_match(pdf, covs, caliper):
    out = {}
    for stratum, part in pdf.groupby("s"):
        x = part[covs].to_numpy() / part[covs].std(ddof=1).to_numpy()
        keys, tr = part["k"].to_numpy(), part["tr"].to_numpy()
        for i in np.where(tr)[0]:
            gap = np.abs(x[~tr] - x[i])
            ok = gap.max(axis=1) <= caliper
            if ok.any():
                dist = (gap**2).sum(axis=1)
                near = ok & (dist <= dist[ok].min() + 1e-5)
                out[keys[i]] = (keys[~tr][near].min(), int(near.sum()))
    return out


def test_matching_with_hot_copies(spark):
    rng = np.random.default_rng(11)
    n, covs = 900, ["x0", "x1", "x2", "x3"]
    pdf = pd.DataFrame(rng.normal(size=(n, 4)).round(1), columns=covs)
    pdf.loc[: n // 3, covs] = [0.3, -0.2, 0.1, 0.0]  # a third of all rows are copies
    pdf["s"] = np.where(rng.random(n) < 0.8, "big", "small")
    pdf["tr"] = rng.random(n) < 0.3
    pdf["k"] = np.arange(n)
    old = matching.LEAF_POINTS, matching.OVERFULL, matching.SAMPLE
    matching.LEAF_POINTS, matching.OVERFULL, matching.SAMPLE = 2, 1, 64  # deep searches, most planes from Spark
    try:
        calipers = [25, 55, 100]
        frame = spark.createDataFrame(pdf)
        scaled = matching.scaled_rows(frame, "k", "tr", "s", covs)
        vectors = matching.sweep(frame, "k", "tr", "s", covs, calipers, scaled)
        got = matching.first_ties(vectors).toPandas()
        ties = matching.numbered_ties(vectors, scaled).toPandas()
    finally:
        matching.LEAF_POINTS, matching.OVERFULL, matching.SAMPLE = old
    for c in calipers:
        part = got[got.caliper == c]
        assert dict(zip(part.treated, zip(part.control, part.n_ties))) == brute_match(pdf, covs, c / 100)
        listed = ties[ties.caliper == c].groupby("treated").agg(n=("control", "nunique"), top=("match_rank", "max"))
        sizes = part.set_index("treated").n_ties.sort_index()
        assert (listed.n == sizes).all() and (listed.top == sizes).all()


def six_covariates(n, rng):
    # Skewed and rounded covariates, correlated as scale scores are.
    base = rng.normal(size=(n, 6)) @ np.linalg.cholesky(0.6 * np.eye(6) + 0.4)
    base[:, 1] = np.exp(base[:, 1])
    base[:, 2:4] = base[:, 2:4].round(1)
    pdf = pd.DataFrame(base, columns=[f"x{j}" for j in range(6)])
    pdf["s"] = np.where(rng.random(n) < 0.7, "f", "m")
    pdf["tr"] = rng.random(n) < 0.3
    pdf["k"] = np.arange(n)
    return pdf


def test_twins_of_six_covariates(spark):
    pdf = six_covariates(5000, np.random.default_rng(4))
    covs = [f"x{j}" for j in range(6)]
    vectors = matching.sweep(spark.createDataFrame(pdf), "k", "tr", "s", covs, [25, 50, 70, 100])
    got = matching.first_ties(vectors).toPandas()
    for c in (25, 50, 70, 100):
        part = got[got.caliper == c]
        assert dict(zip(part.treated, zip(part.control, part.n_ties))) == brute_match(pdf, covs, c / 100)


def test_pairs_of_a_query_do_not_grow_with_the_table(spark):
    made = []
    for n in (8_000, 64_000):
        pdf = six_covariates(n, np.random.default_rng(n))
        scaled = matching.scaled_rows(spark.createDataFrame(pdf), "k", "tr", "s", [f"x{j}" for j in range(6)])
        u = ["stratum", *[f"u{j}" for j in range(6)]]
        controls = scaled.where("NOT treated").groupBy(*u).agg(F.min("key").alias("ckey"), F.count(F.lit(1)).alias("copies"))
        queries = scaled.where("treated AND key % 16 = 0").groupBy(*u).agg(F.min("key").alias("qid"))
        controls, queries, depth = matching._with_leaves(controls, queries, controls.count(), 6)
        laid = matching._Controls(controls, depth, 6)
        asked = queries.withColumn("cal_id", F.lit(100)).withColumn("cal", F.lit(1.0))
        leaves = matching.open_leaves(asked, laid.points, laid.boxes, laid.few_boxes, 6, depth)
        made.append(leaves.agg(F.sum("n")).first()[0] / asked.count())
    # All eligible pairs would grow eightfold.
    assert made[1] < 2 * made[0], made


def test_matches_grow_with_the_caliper(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": range(200), "s": "a", "tr": rng.random(200) < 0.3, "x": rng.normal(size=200), "y": rng.normal(size=200)})
    frame = spark.createDataFrame(pdf)
    vectors = matching.sweep(frame, "k", "tr", "s", ["x", "y"])
    table = matching.retention(frame, "tr", "s", vectors).orderBy("caliper").toPandas()
    assert len(table) == 16 and (table.n_matched.diff().dropna() >= 0).all()
    assert vectors.where(F.col("needed") > F.col("caliper") / 100.0).count() == 0


def test_ties_of_values_one_rounding_step_apart(spark):
    rows = [(i, "a", i % 5 == 0, 0.1 + 0.2 if i % 2 else 0.3, float(i % 3)) for i in range(60)]
    frame = spark.createDataFrame(rows, "k int, s string, tr boolean, x double, y double")
    scaled = matching.scaled_rows(frame, "k", "tr", "s", ["x", "y"])
    vectors = matching.sweep(frame, "k", "tr", "s", ["x", "y"], [100], scaled)
    wanted = matching.first_ties(vectors).agg(F.sum("n_ties")).first()[0]
    assert matching.numbered_ties(vectors, scaled).count() == wanted


def test_quantiles_with_infinite_and_huge_values(spark):
    inf = float("inf")
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 4.0, inf)] + [("b", -1.7e308), ("b", 1.7e308), ("b", 0.0)] + [
        ("c", -inf), ("c", inf), ("c", 5.0)] + [("d", 5e-324), ("d", 0.0), ("d", 1e-323)]
    df = spark.createDataFrame(rows, "g string, x double")
    for times in (1, 3, 1001):
        many = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(times))))
        got = {r.g: list(r.q) for r in quantiles(many, "x", [0.0, 0.5, 1.0], ["g"]).collect()}
        assert got == {"a": [1.0, 3.0, inf], "b": [-1.7e308, 0.0, 1.7e308], "c": [-inf, 5.0, inf], "d": [0.0, 5e-324, 1e-323]}


def test_one_hot_of_many_levels(spark):
    df = spark.range(1500).selectExpr("cast(id as string) AS v")
    assert len(reshape.levels(df, "v")) == 1500


def test_density_curve_against_direct_sum(spark):
    rng = np.random.default_rng(3)
    groups = {"ties": [0.0] * 30 + [1.0] * 5, "one": [7.0] * 4, "zero": [0.0], "outlier": [*rng.normal(size=500), 1e6], "normal": list(rng.normal(size=300))}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("normal", None)], "g string, x double")
    got = plotdata.density_curve(df, "x", ["g"]).toPandas()
    for g, x in groups.items():
        x = np.array(x)
        sd = x.std(ddof=1) if len(x) > 1 else 0.0
        iqr = np.subtract(*np.percentile(x, [75, 25]))
        spread = next(s for s in (min(sd, iqr / 1.34), sd, abs(x.min()), 1.0) if s > 0)
        bw = 0.9 * spread * len(x) ** -0.2
        part = got[got.g == g].sort_values("point")
        want = np.exp(-(((part.x.to_numpy()[:, None] - x) / bw) ** 2) / 2).sum(1) / (len(x) * bw * np.sqrt(2 * np.pi))
        assert len(part) == 64 and np.abs(part.density - want).max() <= 1e-3 * want.max()


def test_decimal_comma_keeps_digits_and_text(spark, tmp_path):
    schema = "k int, v double, t string"
    rows = [(1, 0.123456789012, "line1\nline2"), (2, 1e-9, 'a "quoted"; \\n back\\slash'), (3, 1e33, "\r\ttab"), (4, float("inf"), None), (5, None, "x")]
    df = spark.createDataFrame(rows, schema)
    writers.write_decimal_comma_csv(df, str(tmp_path / "a"))
    writers.write_tsv(df, str(tmp_path / "b"))
    assert sorted(map(tuple, readers.read_decimal_comma_csv(spark, str(tmp_path / "a"), df.schema, escaped=True).collect())) == rows
    assert sorted(map(tuple, readers.read_tsv(spark, str(tmp_path / "b"), df.schema, escaped=True).collect())) == rows
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.csv").write_text("k;v\n1;1.234,5\n2;oops\n")
    plain = readers.read_decimal_comma_csv(spark, str(tmp_path / "c"), df.select("k", "v").schema)
    assert plain.where("k = 1").first().v == 1234.5
    with pytest.raises(Exception, match="not a number in v: oops"):
        plain.select("v").collect()


def test_model_that_cannot_be_fitted_says_why(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(a), float(b), x) for g in "ab" for a, b in rng.normal(size=(40, 2)) for x in ("f" if g == "a" else ["f", "m"][int(a > 0)],)]
    df = spark.createDataFrame(rows, "g string, y0 double, y1 double, sex string")
    got = rm_anova.rm_ancova(df, ["y0", "y1"], {"sex": ["f", "m"]}, by=["g"]).toPandas()
    bad, good = got[got.g == "a"], got[got.g == "b"]
    assert len(bad) == len(good) == 4 and bad.f.isna().all() and (bad.reason == "terms depend on each other").all()
    assert good.f.notna().all() and good.reason.isna().all()


def test_units_do_not_decide_on_a_model(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(5000, 3, size=(300, 3))
    rows = [tuple(map(float, r)) for r in np.column_stack([rng.normal(size=(300, 2)), x])]
    df = spark.createDataFrame(rows, "y0 double, y1 double, a double, b double, c double")
    assert rm_anova.rm_ancova(df, ["y0", "y1"], {"a": None}).where("reason IS NOT NULL").count() == 0


def test_tails_at_very_large_df():
    for df in (1e6, 1e9, 1e11, 1e13, 1e16):
        assert abs(dist.t_tail([1.959963984540054], [df])[0] - 0.05) < 1e-6
        assert abs(dist.f_tail([2.995732273553991], [2.0], [df])[0] - 0.05) < 1e-6


def test_constant_column_in_factor_screen(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), 1.0) for i in range(30)], "a double, b double, c double")
    got = corr.factor_screen(df, ["a", "b", "c"]).orderBy("k").collect()
    assert abs(got[0].eigenvalue + got[1].eigenvalue - 2) < 1e-9 and got[2].eigenvalue is None
