"""Caliper matching and its diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups, matching
from ..session import cut
from ..stats import corr
from .panel import COVARIATES, SIX_COVARIATES
from .registry import query, rounded
from .sql_stats import corr_test, finish_corr

KEYS = dict(key="c_custkey", treated="treated", stratum="c_mktsegment", covariates=COVARIATES)


def _sweep(t, calipers=matching.CALIPERS):
    frame = cut(t.twins)
    return frame, cut(matching.sweep(frame, calipers=calipers, **KEYS))


def _deviations(t, calipers=matching.CALIPERS):
    frame, vectors = _sweep(t, calipers)
    return matching.deviations(matching.first_ties(vectors), frame, "c_custkey", "c_mktsegment", COVARIATES)


@query("j15_caliper_match", "SELECT stratum, treated, control, n_ties, round(dist, 8) AS dist FROM twin_first WHERE caliper = 70")
def _(t):
    _, vectors = _sweep(t, [matching.CHOSEN_CALIPER])
    return rounded(matching.first_ties(vectors).drop("caliper"), 8)


@query("j16_numbered_ties", """
    SELECT caliper, treated, control, row_number() OVER (PARTITION BY caliper, treated ORDER BY dist, control) AS match_rank FROM twin_ties""")
def _(t):
    frame = cut(t.twins)
    scaled = matching.scaled_rows(frame, **KEYS)
    ranked = matching.numbered_ties(cut(matching.sweep(frame, scaled=scaled, **KEYS)), scaled)
    return ranked.select("caliper", "treated", "control", F.col("match_rank").cast("bigint").alias("match_rank"))


@query("j17_caliper_sweep", "SELECT caliper, stratum, treated, control, n_ties, round(dist, 8) AS dist FROM twin_first")
def _(t):
    _, vectors = _sweep(t)
    return rounded(matching.first_ties(vectors), 8)


SIX_SQL = f"""
    WITH sds AS (SELECT c_mktsegment, {", ".join(f"stddev_samp({c}) AS sd_{c}" for c in SIX_COVARIATES)} FROM twins6 GROUP BY c_mktsegment),
    pairs AS (SELECT a.c_mktsegment AS stratum, a.c_custkey AS treated, b.c_custkey AS control,
                greatest({", ".join(f"abs(a.{c} - b.{c}) / sd_{c}" for c in SIX_COVARIATES)}) AS needed,
                {" + ".join(f"pow((a.{c} - b.{c}) / sd_{c}, 2)" for c in SIX_COVARIATES)} AS dist
              FROM twins6 a JOIN twins6 b ON a.c_mktsegment = b.c_mktsegment AND a.treated AND NOT b.treated JOIN sds ON sds.c_mktsegment = a.c_mktsegment),
    ties AS (SELECT CAST(c AS INT) AS caliper, p.* FROM pairs p JOIN (SELECT unnest(range(25, 101, 5)) AS c) ON needed <= c / 100.0
             QUALIFY dist <= min(dist) OVER (PARTITION BY c, treated) + 1e-5)
    SELECT caliper, stratum, treated, min(control) AS control, count(*) AS n_ties, round(min(dist), 8) AS dist FROM ties GROUP BY ALL"""


@query("j17_caliper_sweep_six", SIX_SQL)
def _(t):
    vectors = cut(matching.sweep(t.twins6, **{**KEYS, "covariates": SIX_COVARIATES}))
    return rounded(matching.first_ties(vectors), 8)


@query("j18_pick_caliper", "SELECT treated, control FROM twin_first WHERE caliper = 70")
def _(t):
    _, vectors = _sweep(t)
    return matching.at_caliper(matching.first_ties(vectors)).select("treated", "control")


@query("j19_deviations", """
    SELECT treated, control, round(c_acctbal_dev, 6) AS c_acctbal_dev, round(avg_price_dev, 4) AS avg_price_dev,
           round(c_acctbal_devz, 8) AS c_acctbal_devz, round(avg_price_devz, 8) AS avg_price_devz FROM twin_devs WHERE caliper = 70""")
def _(t):
    dev = _deviations(t, [matching.CHOSEN_CALIPER])
    cols = [f"{c}_{k}" for c in COVARIATES for k in ("dev", "devz")]
    return rounded(dev.select("treated", "control", *cols), 8, c_acctbal_dev=6, avg_price_dev=4)


@query("a18_retention", """
    SELECT CAST(c AS INT) AS caliper, n.stratum, n_treated, coalesce(n_matched, 0) AS n_matched, round(coalesce(n_matched, 0) / n_treated, 8) AS share
    FROM (SELECT unnest(range(25, 101, 5)) AS c) CROSS JOIN (SELECT c_mktsegment AS stratum, count(*) AS n_treated FROM twins WHERE treated GROUP BY 1) n
    LEFT JOIN (SELECT caliper, stratum, count(DISTINCT treated) AS n_matched FROM twin_ties GROUP BY ALL) m ON m.caliper = c AND m.stratum = n.stratum""")
def _(t):
    frame, vectors = _sweep(t)
    return rounded(matching.retention(frame, "treated", "c_mktsegment", vectors), 8)


@query("t20_twin_correlations", finish_corr(" UNION ALL ".join(
    f"SELECT {corr_test(f'{c}_x', f'{c}_y', f'{c}_x', f'{c}_y')} FROM twin_devs WHERE caliper = 70" for c in COVARIATES)))
def _(t):
    dev = _deviations(t, [matching.CHOSEN_CALIPER])
    return rounded(corr.correlation_test(dev, [(f"{c}_x", f"{c}_y") for c in COVARIATES]))


@query("g7_caliper_deviation", """
    SELECT caliper, round(avg(v), 8) AS m, round(stddev_samp(v), 8) AS sd, round(min(v), 8) AS min, round(max(v), 8) AS max
    FROM (SELECT caliper, c_acctbal_devz AS v FROM twin_devs UNION ALL SELECT caliper, avg_price_devz FROM twin_devs) GROUP BY caliper""")
def _(t):
    return rounded(matching.deviation_summary(_deviations(t), COVARIATES, ["caliper"]), 8)


@query("g8_caliper_retained", """
    SELECT CAST(c AS INT) AS caliper, n.stratum, round(coalesce(n_matched, 0) / n_treated, 8) AS share
    FROM (SELECT unnest(range(25, 101, 5)) AS c) CROSS JOIN (SELECT c_mktsegment AS stratum, count(*) AS n_treated FROM twins WHERE treated GROUP BY 1) n
    LEFT JOIN (SELECT caliper, stratum, count(DISTINCT treated) AS n_matched FROM twin_ties GROUP BY ALL) m ON m.caliper = c AND m.stratum = n.stratum""")
def _(t):
    frame, vectors = _sweep(t)
    table = matching.retention(frame, "treated", "c_mktsegment", vectors)
    return rounded(groups.ordered(table.select("caliper", "stratum", "share"), {"stratum": "asc", "caliper": "asc"}), 8)
