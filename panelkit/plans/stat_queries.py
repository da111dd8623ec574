"""Tests, correlations, reliability, predictor choice, repeated measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import groups, joins, keys
from ..session import cut, scratch_path
from ..sources import writers
from ..stats import corr, factors, moments, predictors, reliability, rm_anova, ttests
from .registry import query, rounded
from .sql_stats import NORMAL, corr_test, finish_corr, orthogonal, p_f, p_t

CHANGES = ("avg_price", "n_orders", "max_price")
PREDICTORS = ("avg_price_t0", "avg_price_t1", "c_acctbal", "max_price_t0", "max_price_t1", "n_orders_t0", "n_orders_t1")
TARGETS = tuple(f"{c}_t2minust0" for c in CHANGES)
CHANGE_SQL = "(SELECT w.*, " + ", ".join(f"{c}_t2 - {c}_t0 AS {c}_t2minust0" for c in CHANGES) + " FROM wide w)"


def _changes(t):
    return joins.add_changes(t.wide, CHANGES, 2, 0)


# --- t tests ---------------------------------------------------------------


def _two_sample_sql(var: str) -> str:
    d = "(m1 - m0) / sd"
    half = f"{NORMAL} * sqrt(1.0 / n1 + 1.0 / n0 + pow({d}, 2) / (2 * (n1 + n0)))"
    t = f"(m1 - m0) / (sd * sqrt(1.0 / n1 + 1.0 / n0))"
    p = p_t(t, "n1 + n0 - 2")
    return f"""SELECT '{var}' AS variable, n1, n0, round(m1, 4) AS m1, round(m0, 4) AS m0, round(v1, 2) AS v1, round(v0, 2) AS v0, round(sd, 4) AS sd, round({t}, 6) AS t, CAST(n1 + n0 - 2 AS DOUBLE) AS df,
        round({d}, 6) AS d, round({d} - {half}, 6) AS d_lo, round({d} + {half}, 6) AS d_hi, round({p}, 6) AS p,
        CASE WHEN {p} < .001 THEN '***' WHEN {p} < .01 THEN '**' WHEN {p} < .05 THEN '*' WHEN {p} < .1 THEN '#' WHEN {p} < .2 THEN '##' ELSE '' END AS sig
        FROM (SELECT *, sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS sd FROM (
          SELECT count({var}) FILTER (stayed) AS n1, count({var}) FILTER (NOT stayed) AS n0, avg({var}) FILTER (stayed) AS m1, avg({var}) FILTER (NOT stayed) AS m0,
                 var_samp({var}) FILTER (stayed) AS v1, var_samp({var}) FILTER (NOT stayed) AS v0 FROM attr))"""


ATTRITION = ("avg_price", "n_orders", "max_price", "c_acctbal")
ATTR_SQL = """WITH attr AS (SELECT p.*, c_custkey IN (SELECT c_custkey FROM panel WHERE wave = 2 AND max_price > 400000) AS stayed FROM panel p WHERE wave = 0) """


def _attrition(t):
    kept = t.panel.where("wave = 2 AND max_price > 400000").select("c_custkey")
    return keys.flag_members(t.panel.where("wave = 0"), kept, "c_custkey", "stayed")


@query("t1_attrition_tests", ATTR_SQL + " UNION ALL ".join(_two_sample_sql(v) for v in ATTRITION))
def _(t):
    return rounded(ttests.two_sample(_attrition(t), ATTRITION, "stayed"), 6, m1=4, m0=4, sd=4, v1=2, v0=2)


def _one_sample_sql(label: str, expr: str, source: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    t = "m / (sd / sqrt(n))"
    half = f"{NORMAL} * sqrt(1.0 / n + pow(m / sd, 2) / (2 * n))"
    return f"""SELECT '{label}' AS variable, {head}n, round(m, 4) AS m, round(sd, 4) AS sd, round({t}, 6) AS t, CAST(n - 1 AS DOUBLE) AS df, round(m / sd, 6) AS d,
        round(m / sd - {half}, 6) AS d_lo, round(m / sd + {half}, 6) AS d_hi, round({p_t(t, 'n - 1')}, 6) AS p
        FROM (SELECT {head}count({expr}) AS n, avg({expr}) AS m, stddev_samp({expr}) AS sd FROM {source} {group})"""


@query("t2_change_against_zero", " UNION ALL ".join(_one_sample_sql(c, c, CHANGE_SQL) for c in TARGETS))
def _(t):
    return rounded(ttests.one_sample(_changes(t), TARGETS), 6, m=4, sd=4)


@query("t3_paired_waves", " UNION ALL ".join(
    _one_sample_sql(f"avg_price_t{a} - avg_price_t{b}", f"(avg_price_t{a} - avg_price_t{b})", "wide") for a, b in ((1, 0), (2, 1), (2, 0))))
def _(t):
    pairs = [(f"avg_price_t{a}", f"avg_price_t{b}") for a, b in ((1, 0), (2, 1), (2, 0))]
    return rounded(ttests.paired(t.wide, pairs), 6, m=4, sd=4)


# --- correlations ----------------------------------------------------------


@query("t4_correlation_tests", finish_corr(" UNION ALL ".join(
    f"SELECT {corr_test(a, b, a, b)} FROM items" for a, b in (("i1", "i4"), ("i2", "i3"), ("i1", "i5")))))
def _(t):
    return rounded(corr.correlation_test(t.items, [("i1", "i4"), ("i2", "i3"), ("i1", "i5")]))


@query("t5_correlation_per_group", finish_corr(
    f"SELECT {corr_test('avg_price', 'c_acctbal', 'avg_price', 'c_acctbal', ['c_mktsegment', 'wave'])} FROM panel GROUP BY c_mktsegment, wave", ["c_mktsegment", "wave"]))
def _(t):
    return rounded(corr.correlation_test(t.panel, [("avg_price", "c_acctbal")], ["c_mktsegment", "wave"]))


@query("t6_slope_moderator", finish_corr(" UNION ALL ".join(
    f"SELECT {corr_test(m, 's', m, 'slope')} FROM (SELECT w.*, avg_price_t1 - avg_price_t0 AS s FROM wide w)" for m in ("c_acctbal", "n_orders_t0"))))
def _(t):
    return rounded(corr.slope_correlation(t.wide, ["c_acctbal", "n_orders_t0"], "avg_price_t1", "avg_price_t0"))


ITEMS = ["i1", "i2", "i3", "i4", "i5"]
ITEM_PAIRS = [(a, b) for k, a in enumerate(ITEMS) for b in ITEMS[k + 1:]]
MATRIX_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM items" for a, b in ITEM_PAIRS)


@query("t7_correlation_matrix", f"SELECT x, y, n, round(r, 8) AS r FROM ({MATRIX_SQL})")
def _(t):
    return rounded(corr.correlation_matrix(t.items, ITEMS), 8)


COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in ITEMS)


@query("t8_correlation_complete_cases", " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, round(covar_samp({a}, {b}), 6) AS cov, round(corr({a}, {b}), 8) AS r FROM items WHERE {COMPLETE}"
    for k, a in enumerate(ITEMS) for b in ITEMS[k:]))
def _(t):
    return rounded(moments.covariances(t.items, ITEMS), 8, cov=6)


FLAT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("t8_moments_per_group", " UNION ALL ".join(
    f"SELECT l_returnflag, '{a}' AS x, '{b}' AS y, count(*) AS n, round(covar_samp({a}, {b}), {0 if a == b == 'l_extendedprice' else 4}) AS cov, round(corr({a}, {b}), 8) AS r FROM lineitem GROUP BY l_returnflag"
    for k, a in enumerate(FLAT) for b in FLAT[k:]))
def _(t):
    out = moments.covariances(t.lineitem, FLAT, ["l_returnflag"])
    # The variance of prices is near 1e9: the last of its digits depend on the order of sums.
    large = F.when(F.col("x") == F.col("y"), F.col("x")) == "l_extendedprice"
    return rounded(out.withColumn("cov", F.when(large, F.round("cov", 0)).otherwise(F.col("cov"))), 8, cov=4)


# Eigenvalues of a 3 x 3 correlation matrix have a closed form.
EIGEN_SQL = f"""
    WITH r AS (SELECT corr(i1, i4) AS a, corr(i1, i5) AS b, corr(i4, i5) AS c FROM items WHERE i1 IS NOT NULL AND i4 IS NOT NULL AND i5 IS NOT NULL),
    f AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM r),
    g AS (SELECT p, acos(a * b * c / pow(p, 3)) / 3 AS phi FROM f),
    e AS (SELECT 1 + 2 * p * cos(phi) AS e1, 1 + 2 * p * cos(phi + 2 * pi() / 3) AS e3 FROM g),
    v AS (SELECT unnest([{{'k': 1, 'eigenvalue': e1}}, {{'k': 2, 'eigenvalue': 3 - e1 - e3}}, {{'k': 3, 'eigenvalue': e3}}], recursive := true), e1 + e3 - 2 * (3 - e1 - e3) AS bend FROM e)
    """


@query("t9_factor_screen", EIGEN_SQL + """
    SELECT k, round(eigenvalue, 6) AS eigenvalue, round(eigenvalue / 3, 6) AS share, CASE WHEN k = 2 THEN round(bend, 6) END AS acceleration,
           eigenvalue > 1 AS over_one, k = 1 AS before_elbow FROM v""")
def _(t):
    return rounded(corr.factor_screen(t.items, ["i1", "i4", "i5"]))


@query("t9_factor_screen_many")
def _(t):
    names = [f"v{k}" for k in range(20)]
    flat = t.embeddings.select(*[F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)])
    return rounded(corr.factor_screen(flat, names))


@query("t10_cronbach_alpha", """
    SELECT count(i1 + i2 + i3 + i4 + i5) AS n, round(5 / 4.0 * (1 - (var_samp(i1) + var_samp(i2) + var_samp(i3) + var_samp(i4) + var_samp(i5))
           / var_samp(i1 + i2 + i3 + i4 + i5)), 8) AS alpha FROM items""")
def _(t):
    return rounded(reliability.cronbach_alpha(t.items, ITEMS), 8)


def _alpha_sql(block: str, count: int) -> str:
    cols = [f"{block}_{i:02d}" for i in range(1, count + 1)]
    return f"""SELECT '{block}' AS block, count({' + '.join(cols)}) AS n, round({count} / {count - 1}.0 * (1 - ({' + '.join(f'var_samp({c})' for c in cols)})
        / var_samp({' + '.join(cols)})), 8) AS alpha FROM survey"""


@query("t10_cronbach_alpha_blocks", _alpha_sql("AS01", 18) + " UNION ALL " + _alpha_sql("PS01", 16) + " UNION ALL " + _alpha_sql("ST02", 20))
def _(t):
    parts = [
        reliability.cronbach_alpha(t.survey, [f"{b}_{i:02d}" for i in range(1, n + 1)]).withColumn("block", F.lit(b))
        for b, n in (("AS01", 18), ("PS01", 16), ("ST02", 20))
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 8)


# The three symptom scales item by item, reversed items turned round.
TURNED = {"PS01": (6, (1, 3, 8, 10, 11)), "ST02": (5, (1, 3, 6, 7, 10, 13, 14, 16, 19))}
SYMPTOM_ITEMS = {
    f"{b}_{i:02d}": f"{TURNED[b][0]} - {b}_{i:02d}" if b in TURNED and i in TURNED[b][1] else f"{b}_{i:02d}"
    for b, n in (("AS01", 18), ("PS01", 16), ("ST02", 20)) for i in range(1, n + 1)
}


def _symptoms(t):
    # As a written table: what the planner infers from 54 computed columns grows with every pair of them.
    items = t.survey.selectExpr(*[f"{e} AS {n}" for n, e in SYMPTOM_ITEMS.items()])
    return writers.write_snapshot(items, scratch_path(t.spark, "symptoms"))


def _turned_alpha_sql(block: str) -> str:
    cols = [f"({e})" for n, e in SYMPTOM_ITEMS.items() if n.startswith(block)]
    return f"""SELECT '{block}' AS block, count({' + '.join(cols)}) AS n, round({len(cols)} / {len(cols) - 1}.0 * (1 - ({' + '.join(f'var_samp({c})' for c in cols)})
        / var_samp({' + '.join(cols)})), 8) AS alpha FROM survey"""


@query("t10_cronbach_alpha_turned", " UNION ALL ".join(_turned_alpha_sql(b) for b in ("AS01", "PS01", "ST02")))
def _(t):
    items = _symptoms(t)
    parts = [reliability.cronbach_alpha(items, [n for n in SYMPTOM_ITEMS if n.startswith(b)]).withColumn("block", F.lit(b)) for b in ("AS01", "PS01", "ST02")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 8)


# Eigenvalues have no SQL form; the sums of their powers are traces of powers of the matrix.
@query("t9_eigenvalue_sums_items", f"""
    WITH c AS (SELECT o_orderkey AS id, [{", ".join(f"CAST({e} AS DOUBLE)" for e in SYMPTOM_ITEMS.values())}] AS v FROM survey
               WHERE {" AND ".join(f"{n} IS NOT NULL" for n in SYMPTOM_ITEMS)}),
    l AS (SELECT id, unnest(range({len(SYMPTOM_ITEMS)})) AS j, unnest(v) AS v FROM c),
    r AS (SELECT a.j AS i, b.j AS j, corr(a.v, b.v) AS r FROM l a JOIN l b USING (id) GROUP BY ALL)
    SELECT (SELECT count(*) FROM c) AS n, count(*) FILTER (i = j) AS k, round(sum(r) FILTER (i = j), 6) AS trace, round(sum(r * r), 5) AS squares,
           round((SELECT sum(a.r * b.r * c.r) FROM r a JOIN r b ON a.j = b.i JOIN r c ON b.j = c.i AND c.j = a.i), 4) AS cubes FROM r""")
def _(t):
    items = _symptoms(t)
    e = corr.factor_screen(items, list(SYMPTOM_ITEMS))
    sums = e.agg(F.count("eigenvalue").alias("k"), F.sum("eigenvalue").alias("trace"), F.sum(F.col("eigenvalue") ** 2).alias("squares"),
                 F.sum(F.col("eigenvalue") ** 3).alias("cubes"))
    complete = items.dropna().agg(F.count(F.lit(1)).alias("n"))
    return rounded(sums.withColumn("n", joins.constant(complete, "n")), 6, squares=5, cubes=4)


@query("t9_scree_rules_items")
def _(t):
    return rounded(factors.scree_rules(_symptoms(t), list(SYMPTOM_ITEMS)))


@query("t9_factor_counts_items")
def _(t):
    rules = cut(factors.scree_rules(_symptoms(t), list(SYMPTOM_ITEMS)))
    return factors.factor_counts(rules).withColumn("rule", F.lit("parallel")).unionByName(
        factors.factor_counts(rules, "one").withColumn("rule", F.lit("one")))


# --- choosing predictors ---------------------------------------------------

TRAIN_SQL = "('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT % 4 < 3"


@query("t11_train_split", f"SELECT c_custkey, {TRAIN_SQL} AS train FROM customer")
def _(t):
    return t.customer.select("c_custkey", predictors.train_flag("c_custkey").alias("train"))


def _train(t):
    return _changes(t).where(predictors.train_flag("c_custkey"))


@query("t12_elastic_net_path")
def _(t):
    return rounded(predictors.elastic_net_path(_train(t), PREDICTORS, TARGETS), 6)


# With one predictor every step of the path has a closed form.
ONE_PATH_SQL = f"""
    WITH d AS (SELECT avg_price_t0 AS x, avg_price_t2minust0 AS y FROM {CHANGE_SQL} WHERE {TRAIN_SQL}),
    m AS (SELECT corr(x, y) AS r, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM d),
    steps AS (SELECT m.*, CAST(k + 1 AS INT) AS step, abs(r) / 0.5 * pow(1e-4::DOUBLE, k / 1999.0) AS lam FROM m, (SELECT unnest(range(0, 2000)) AS k)),
    fits AS (SELECT *, sign(r) * greatest(abs(r) - lam * 0.5, 0) / (1 + lam * 0.5) AS b FROM steps),
    gains AS (SELECT *, 2 * r * b - b * b AS fit, lag(2 * r * b - b * b, 1, 0) OVER (ORDER BY step) AS before FROM fits),
    ends AS (SELECT min(step) AS last FROM gains WHERE (step > 5 AND fit - before < 1e-5 * fit) OR fit > 0.999)
    """


@query("t12_elastic_net_one_predictor", ONE_PATH_SQL + f"""
    SELECT '{TARGETS[0]}' AS target, step, round(lam * sy, 4) AS lambda, 'avg_price_t0' AS predictor, round(b * sy / sx, 8) AS beta
    FROM gains, ends WHERE step <= coalesce(last, 2000)""")
def _(t):
    out = predictors.elastic_net_path(_train(t), ["avg_price_t0"], [TARGETS[0]])
    return rounded(out, 8, **{"lambda": 4})


@query("t13_predictor_ranking")
def _(t):
    return predictors.rank_predictors(predictors.elastic_net_path(_train(t), PREDICTORS, TARGETS))


def _nested_sql(target: str) -> tuple[str, str]:
    source = "(SELECT " + ", ".join(f"({p} - avg({p}) OVER ()) / stddev_samp({p}) OVER () AS {p}" for p in PREDICTORS) + f", ({target} - avg({target}) OVER ()) / stddev_samp({target}) OVER () AS y, stddev_samp({target}) OVER () AS sd FROM {CHANGE_SQL}) s"
    name = target.split("_t2")[0]
    ctes, last = orthogonal(f"base_{name}", list(PREDICTORS), f"q_{name}_")
    gains = ", ".join(f"pow(sum(y * q_{name}_{k}), 2) / sum(pow(q_{name}_{k}, 2)) AS g{k}" for k in range(1, len(PREDICTORS) + 1))
    ctes = [f"base_{name} AS (SELECT * FROM {source})", *ctes,
            f"sums_{name} AS (SELECT count(*) AS n, sum(y * y) AS tot, max(sd) AS sd, {gains} FROM {last})"]
    rows = " UNION ALL ".join(
        f"SELECT '{target}' AS target, '{PREDICTORS[k - 1]}' AS predictor, {k} AS row, n, tot, tot - ({' + '.join(f'g{j}' for j in range(1, k + 1))}) AS rss, sd FROM sums_{name}"
        for k in range(1, len(PREDICTORS) + 1))
    return ", ".join(ctes), rows


def _nested_query() -> str:
    parts = [_nested_sql(t) for t in TARGETS]
    head = "WITH " + ", ".join(p[0] for p in parts) + ", fits AS (" + " UNION ALL ".join(p[1] for p in parts) + ")"
    return head + f""", done AS (SELECT target, predictor, row, n * ln(2 * pi()) + n * ln(rss * sd * sd / n) + n + ln(n) * (row + 2) AS bic,
        1 - (rss / (n - row - 1)) / (tot / (n - 1)) AS adj, ((tot - rss) / row) / (rss / (n - row - 1)) AS f, n FROM fits)
        SELECT target, predictor, row, round(bic, 4) AS bic, round(adj, 6) AS r_sq_adj, round(f, 4) AS f,
               round(bic - min(bic) OVER (PARTITION BY target), 4) AS bic_diff_to_min, CAST(n AS DOUBLE) AS n, round({p_f('f', 'row', '(n - row - 1)')}, 6) AS p FROM done"""


@query("t14_nested_models", _nested_query())
def _(t):
    data = cut(_changes(t))
    # Ranks as given: alphabetical, the same for every target.
    order = [(g, p, k) for g in TARGETS for k, p in enumerate(PREDICTORS, 1)]
    ranked = t.spark.createDataFrame(order, "target string, predictor string, row int")
    out = predictors.nested_models(data, ranked, PREDICTORS, TARGETS)
    columns = ("target", "predictor", "row", "bic", "r_sq_adj", "f", "bic_diff_to_min", "n", "p")
    return rounded(out.select(*columns), 4, r_sq_adj=6, p=6)


@query("t15_target_correlations", finish_corr(" UNION ALL ".join(
    f"SELECT {corr_test(x, g, x, g)} FROM {CHANGE_SQL} WHERE {TRAIN_SQL}" for g in TARGETS for x in PREDICTORS)))
def _(t):
    out = predictors.target_correlations(_train(t), PREDICTORS, TARGETS)
    return rounded(out.withColumnsRenamed({"predictor": "x", "target": "y"}))


@query("t16_choose_for_all_targets")
def _(t):
    out = predictors.choose_predictors(cut(_changes(t)), "c_custkey", PREDICTORS, TARGETS)
    return rounded(out, 4)


@query("t17_chosen_predictors")
def _(t):
    models = predictors.choose_predictors(cut(_changes(t)), "c_custkey", PREDICTORS, TARGETS)
    return predictors.chosen(models).select("target", "row", "predictor")


# --- repeated measures -----------------------------------------------------

# Waves and the covariate are scaled by constants, as in any analysis of
# standardised scores.
RM_SOURCE = """(SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS g, c_acctbal / 1000 AS x,
    (CASE WHEN c_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * c_acctbal / 1000 AS gx, 1.0::DOUBLE AS one,
    (avg_price_t0 + avg_price_t1 + avg_price_t2) / 100000 / sqrt(3.0::DOUBLE) AS yb, (avg_price_t1 - avg_price_t0) / 100000 / sqrt(2.0::DOUBLE) AS z1,
    (avg_price_t0 + avg_price_t1 - 2 * avg_price_t2) / 100000 / sqrt(6.0::DOUBLE) AS z2 FROM wide)"""
RM_TERMS = {"(Intercept)": ["g", "x", "gx", "one"], "sex": ["one", "x", "gx", "g"], "bal": ["one", "g", "gx", "x"], "sex:bal": ["one", "g", "x", "gx"]}


def _rm_sql(by: str = "") -> str:
    over = f"PARTITION BY {by}" if by else ""
    head, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    ctes, terms = [f"src AS (SELECT * FROM {RM_SOURCE})"], []
    for k, (term, order) in enumerate(RM_TERMS.items()):
        steps, last = orthogonal("src", order, f"o{k}_", over)
        ctes += steps
        terms.append(
            f"SELECT {head}'{term}' AS name, pow(sum(o{k}_4 * yb), 2) / sum(o{k}_4 * o{k}_4) AS ss_b, "
            f"(pow(sum(o{k}_4 * z1), 2) + pow(sum(o{k}_4 * z2), 2)) / sum(o{k}_4 * o{k}_4) AS ss_w FROM {last} {group}")
    e = lambda a, b: f"sum({a} * {b})" + "".join(f" - sum(o0_{j} * {a}) * sum(o0_{j} * {b}) / sum(o0_{j} * o0_{j})" for j in range(1, 5))
    ctes += [
        "terms AS (" + " UNION ALL ".join(terms) + ")",
        f"err AS (SELECT {head}count(*) - 4 AS dfe, {e('yb', 'yb')} AS eb, {e('z1', 'z1')} AS e11, {e('z2', 'z2')} AS e22, {e('z1', 'z2')} AS e12 FROM o0__4 {group})",
    ]
    join = f"terms JOIN err USING ({by})" if by else "terms, err"
    ctes.append(f"""tests AS (
        SELECT {head}name AS term, 'between' AS part, 1.0::DOUBLE AS df1, CAST(dfe AS DOUBLE) AS df2, 1.0::DOUBLE AS epsilon, ss_b AS ss, eb AS ss_error,
               ss_b / (eb / dfe) AS f, eb + e11 + e22 AS errors FROM {join}
        UNION ALL
        SELECT {head}CASE WHEN name = '(Intercept)' THEN 'time' ELSE name || ':time' END, 'within', 2 * eps, 2 * eps * dfe, eps, ss_w, e11 + e22,
               (ss_w / 2) / ((e11 + e22) / (2 * dfe)), eb + e11 + e22
        FROM (SELECT *, pow(e11 + e22, 2) / (2 * (e11 * e11 + 2 * e12 * e12 + e22 * e22)) AS eps FROM {join}))""")
    part = f"PARTITION BY {by}" if by else ""
    return "WITH " + ", ".join(ctes) + f"""
        SELECT {head}term, part, round(df1, 6) AS df1, round(df2, 4) AS df2, round(epsilon, 6) AS epsilon, round(ss, 6) AS ss, round(ss_error, 4) AS ss_error,
               round(f, 4) AS f, round({p_f('f', 'df1', 'df2')}, 5) AS p,
               round(ss / (ss + errors + measured - CASE WHEN seen THEN ss ELSE 0 END), 6) AS ges
        FROM (SELECT *, sum(CASE WHEN seen THEN ss ELSE 0 END) OVER ({part}) AS measured
              FROM (SELECT *, term NOT IN ('(Intercept)', 'time') AS seen FROM tests))"""


def _rm_frame(t):
    scaled = {f"y{w}": F.col(f"avg_price_t{w}") / 100000 for w in (0, 1, 2)}
    sex = F.when(F.col("c_custkey") % 2 == 0, "f").otherwise("m")
    return t.wide.withColumns({**scaled, "sex": sex, "bal": F.col("c_acctbal") / 1000})


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
RM_DIGITS = {"df2": 4, "ss_error": 4, "f": 4, "p": 5}


@query("t18_rm_ancova", _rm_sql())
def _(t):
    out = rm_anova.rm_ancova(_rm_frame(t), ["y0", "y1", "y2"], {"sex": ["f", "m"], "bal": None})
    return rounded(out.drop("reason"), 6, **RM_DIGITS)


@query("t19_rm_ancova_subgroups", _rm_sql("c_mktsegment"))
def _(t):
    out = rm_anova.rm_ancova(_rm_frame(t), ["y0", "y1", "y2"], {"sex": ["f", "m"], "bal": None}, by=["c_mktsegment"])
    return rounded(out.drop("reason"), 6, **RM_DIGITS)


@query("t18_rm_ancova_many_terms")
def _(t):
    frame = groups.zscore(_rm_frame(t), ["c_acctbal", "n_orders_t0"])
    between = {"sex": ["f", "m"], "c_acctbal_z": None, "n_orders_t0_z": None, "c_mktsegment": SEGMENTS}
    return rounded(rm_anova.rm_ancova(frame, ["y0", "y1", "y2"], between), 6, **RM_DIGITS)


@query("t21_change_scores", "SELECT c_custkey, " + ", ".join(f"round({c}, 6) AS {c}" for c in TARGETS) + f" FROM {CHANGE_SQL}")
def _(t):
    return rounded(_changes(t).select("c_custkey", *TARGETS), 6)


@query("t22_attrition_means", ATTR_SQL + "SELECT stayed, count(*) AS n, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in ATTRITION) + " FROM attr GROUP BY stayed")
def _(t):
    return rounded(groups.group_means(_attrition(t), ATTRITION, ["stayed"]), 4)


# --- report strings --------------------------------------------------------

P_TEXT_SQL = "CASE WHEN p < .001 THEN 'p < .001' ELSE printf('p = %.3f', p) END"


@query("x24_report_t", f"""
    SELECT variable, printf('t(%.0f) = %.2f', df, t) || ', ' || {P_TEXT_SQL} || ', ' || printf('d = %.2f [%.2f; %.2f]', d, d_lo, d_hi) AS report
    FROM ({ATTR_SQL} {" UNION ALL ".join(_two_sample_sql(v) for v in ATTRITION)})""")
def _(t):
    tests = rounded(ttests.two_sample(_attrition(t), ATTRITION, "stayed"))
    return tests.select("variable", labels.report_t("t", "df", "p", "d", "d_lo", "d_hi").alias("report"))


@query("x24_report_r", "SELECT c_mktsegment, wave, printf('r(%.0f) = %.2f [%.2f; %.2f]', df, r, lo, hi) || ', ' || " + P_TEXT_SQL + " AS report FROM (" + finish_corr(
    f"SELECT {corr_test('avg_price', 'c_acctbal', 'avg_price', 'c_acctbal', ['c_mktsegment', 'wave'])} FROM panel GROUP BY c_mktsegment, wave", ["c_mktsegment", "wave"]) + ")")
def _(t):
    tests = rounded(corr.correlation_test(t.panel, [("avg_price", "c_acctbal")], ["c_mktsegment", "wave"]))
    return tests.select("c_mktsegment", "wave", labels.report_r("r", "df", "p", "lo", "hi").alias("report"))


@query("x24_report_f", f"""
    SELECT term, part, printf('F(%.2f, %.2f) = %.2f', df1, df2, f) || ', ' || {P_TEXT_SQL} || ', ' || printf('ges = %.3f', ges) AS report FROM ({_rm_sql()})""")
def _(t):
    out = rm_anova.rm_ancova(_rm_frame(t), ["y0", "y1", "y2"], {"sex": ["f", "m"], "bal": None})
    tests = rounded(out.drop("reason"), 6, **RM_DIGITS)
    return tests.select("term", "part", labels.report_f("f", "df1", "df2", "p", "ges").alias("report"))
