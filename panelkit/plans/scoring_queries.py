"""Questionnaire scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import labels, missing, scales, scoring, text
from ..operators import groups
from ..operators import select as sel
from .panel import BATTERY
from .registry import query, r, rounded

ITEMS = ["i1", "i2", "i3", "i4", "i5"]
ID = ["l_orderkey", "l_linenumber", "l_partkey"]
ID_SQL = "l_orderkey, l_linenumber, l_partkey"


def _present(cols) -> str:
    return "(" + " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in cols) + ")"


def _prorated(cols, limit="0.2", exprs=None) -> str:
    exprs = exprs or list(cols)
    total = " + ".join(f"coalesce(CAST({e} AS DOUBLE), 0)" for e in exprs)
    n, k = _present(cols), len(cols)
    return f"CASE WHEN {n} > 0 AND ({k} - {n}) / {k}.0 <= {limit} THEN ({total}) / {n} * {k} END"


@query("q1_missing_share_list", f"SELECT {ID_SQL}, (5 - {_present(ITEMS)}) / 5.0::DOUBLE AS share FROM items")
def _(t):
    return t.items.select(*ID, scoring.missing_share(ITEMS).alias("share"))


@query("q2_missing_share_prefix", f"SELECT o_orderkey, round((10 - {_present([f'B039_{i:02d}' for i in range(1, 11)])}) / 10.0, 6)::DOUBLE AS share FROM survey")
def _(t):
    return t.survey.select("o_orderkey", r(scoring.missing_share(sel.starts_with("b039")(t.survey))).alias("share"))


@query("q3_prorated_sum_list", f"SELECT {ID_SQL}, round({_prorated(ITEMS)}, 6) AS score, round({_prorated(ITEMS, '1')}, 6) AS score_any FROM items")
def _(t):
    return t.items.select(*ID, r(scoring.prorated_sum(ITEMS, 0.2)).alias("score"), r(scoring.prorated_sum(ITEMS)).alias("score_any"))


@query("q4_prorated_sum_prefix", f"SELECT o_orderkey, round({_prorated([f'FC01_{i:02d}' for i in range(1, 8)])}, 6) AS foc FROM survey")
def _(t):
    return t.survey.select("o_orderkey", r(scoring.prorated_sum(sel.starts_with("FC01")(t.survey), 0.2)).alias("foc"))


@query("q5_shift_items", "SELECT o_orderkey, PH01_01 - 1 AS PH01_01, PH01_02 - 1 AS PH01_02 FROM survey")
def _(t):
    block = t.survey.select("o_orderkey", *sel.starts_with("PH01")(t.survey))
    return sel.across(block, sel.starts_with("PH01"), lambda c: scoring.shift(c, -1))


@query("q6_reverse_items", f"SELECT {ID_SQL}, 6 - a1 AS a1, a2, 6 - a3 AS a3 FROM answers")
def _(t):
    return sel.across(t.answers.select(*ID, "a1", "a2", "a3"), sel.all_of("a1", "a3"), lambda c: scoring.reverse(c, 6))


def _scale_sql(scale) -> str:
    """A score written out in SQL from the item numbers."""
    block = next(b for b in scales.BLOCKS if b.prefix == scale.block)
    numbers = list(scale.items or BATTERY[scale.block][0])
    names = [f"{scale.block}_{n:02d}" for n in numbers]
    exprs = []
    for n, name in zip(numbers, names):
        e = f"({name} + {block.shift})"
        exprs.append(f"({block.low_plus_high} - {e})" if n in block.reversed_items else e)
    if scale.how == "item":
        return f"CAST({exprs[0]} AS DOUBLE)"
    score = _prorated(names, exprs=exprs)
    return f"({score}) / {len(names)}" if scale.how == "mean" else score


def _battery_sql(chosen) -> str:
    parts = {s.name: _scale_sql(s) for s in chosen if not s.sum_of}
    for s in chosen:
        if s.sum_of:
            parts[s.name] = " + ".join(f"({parts[p]})" for p in s.sum_of)
    return "SELECT o_orderkey, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in parts.items()) + " FROM survey"


@query("q7_scale_battery", _battery_sql(scales.SCALES))
def _(t):
    scored = scales.score(t.survey)
    return rounded(scored.select("o_orderkey", *[s.name for s in scales.SCALES]))


@query("q7_scale_battery_middle_wave", _battery_sql(scales.middle_wave_scales()))
def _(t):
    scored = scales.score(t.survey, scales.middle_wave_scales())
    return rounded(scored.select("o_orderkey", *scales.MIDDLE_WAVE))


@query("q8_mean_item", f"SELECT {ID_SQL}, round(({_prorated(ITEMS)}) / 5, 6) AS score FROM items")
def _(t):
    return t.items.select(*ID, r(scoring.mean_item(ITEMS, 0.2)).alias("score"))


@query("q9_strict_mean", f"SELECT {ID_SQL}, round((i1 + i2 + i3 + i4 + i5) / 5, 6) AS m FROM items")
def _(t):
    return t.items.select(*ID, r(missing.strict_mean(ITEMS)).alias("m"))


@query("q10_reversed_mean", f"SELECT {ID_SQL}, 6 - (a3 + a8) / 2 AS m, 6 - a3 AS single FROM answers")
def _(t):
    return t.answers.select(*ID, scoring.reverse(missing.strict_mean(["a3", "a8"]), 6).alias("m"), scoring.reverse("a3", 6).alias("single"))


@query("q11_row_sum_pattern", f"SELECT {ID_SQL}, CAST(a1 + a2 + a3 + a4 + a5 + a6 + a7 + a8 AS DOUBLE) AS total FROM answers")
def _(t):
    cols = (sel.starts_with("a") & sel.matches(r"\d$"))(t.answers)
    return t.answers.select(*ID, missing.strict_sum(cols).alias("total"))


@query("q12_total_check", """
    SELECT diff, count(*) AS n FROM (SELECT i4 + i5 + i3 - (i3 + 2) AS diff FROM items) WHERE diff IS NOT NULL GROUP BY diff""")
def _(t):
    diff = missing.strict_sum(["i4", "i5", "i3"]) - (F.col("i3") + 2)
    return groups.frequency(t.items.select(diff.alias("diff")), "diff")


# Parts counted in the text against the stored number of characters; a part that did not
# occur is missing, and so is the row's sum.
@query("q12_stored_total", """
    SELECT diff, count(*) AS n FROM (
        SELECT length(regexp_replace(text, '[^a-z]', '', 'g')) + nullif(length(regexp_replace(text, '[^0-9]', '', 'g')), 0)
               + length(regexp_replace(text, '[a-z0-9]', '', 'g')) - n_chars AS diff FROM documents)
    GROUP BY diff""")
def _(t):
    def size(without):
        return F.length(F.regexp_replace("text", without, "")).cast("bigint")

    parts = t.documents.select("n_chars", size("[^a-z]").alias("letters"), F.nullif(size("[^0-9]"), F.lit(0)).alias("digits"),
                               size("[a-z0-9]").alias("others"))
    diff = missing.strict_sum(["letters", "digits", "others"]) - F.col("n_chars")
    return groups.frequency(parts.select(diff.cast("bigint").alias("diff")), "diff", with_missing=True)


@query("q13_severest_flag", f"""
    SELECT {ID_SQL}, CASE WHEN f4 IS NULL THEN NULL WHEN f4 = 2 THEN 4 WHEN f3 IS NULL THEN NULL WHEN f3 = 2 THEN 3
           WHEN f2 IS NULL THEN NULL WHEN f2 = 2 THEN 2 WHEN f1 IS NULL THEN NULL WHEN f1 = 2 THEN 1 ELSE 0 END AS infection FROM answers""")
def _(t):
    return t.answers.select(*ID, labels.severest(["f1", "f2", "f3", "f4"]).alias("infection"))


@query("q14_strict_max", f"""
    SELECT {ID_SQL}, CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL AND a3 IS NOT NULL THEN greatest(a1, a2, a3) END AS worst FROM answers""")
def _(t):
    return t.answers.select(*ID, missing.strict_max(["a1", "a2", "a3"]).alias("worst"))


@query("q15_three_bins", f"""
    SELECT {ID_SQL}, CASE WHEN a1 = 1 THEN 1 WHEN a1 > 1 AND a1 < 5 THEN 2 WHEN a1 = 5 THEN 3 END AS c1,
           CASE WHEN a2 = 1 THEN 1 WHEN a2 > 1 AND a2 < 5 THEN 2 WHEN a2 = 5 THEN 3 END AS c2 FROM answers""")
def _(t):
    return t.answers.select(*ID, labels.three_bins("a1").alias("c1"), labels.three_bins("a2").alias("c2"))


@query("q16_two_bins", f"""
    SELECT {ID_SQL}, CASE WHEN a1 < 4 THEN 1 WHEN a1 > 3 THEN 2 END AS need, CASE WHEN a3 < 3 THEN 2 WHEN a3 > 2 THEN 1 END AS opinion FROM answers""")
def _(t):
    return t.answers.select(*ID, labels.two_bins("a1", 3.5).alias("need"), labels.two_bins("a3", 2.5, low=2, high=1).alias("opinion"))


@query("q17_code_labels", f"""
    SELECT {ID_SQL}, CASE a1 WHEN 1 THEN 'male' WHEN 2 THEN 'female' WHEN 3 THEN 'diverse' END AS gender,
           CASE WHEN a2 = 3 THEN 'german' WHEN a2 <> 3 THEN 'other' END AS citizenship FROM answers""")
def _(t):
    return t.answers.select(*ID, labels.label("a1", {1: "male", 2: "female", 3: "diverse"}).alias("gender"),
                            labels.label("a2", {3: "german"}, other="other").alias("citizenship"))


@query("q18_any_flag_yes_no", f"""
    SELECT {ID_SQL}, CASE WHEN f1 = 2 OR f2 = 2 THEN 'yes' WHEN f1 = 1 OR f2 = 1 THEN 'no' END AS child FROM answers""")
def _(t):
    return t.answers.select(*ID, labels.yes_no(["f1", "f2"]).alias("child"))


@query("q19_priority_class", f"""
    SELECT {ID_SQL}, CASE WHEN f1 = 2 OR f2 = 2 THEN 'studies' WHEN f3 = 2 THEN 'unemployed'
           WHEN f1 = 1 AND f2 = 1 AND f4 = 2 THEN 'employed' END AS occupation FROM answers""")
def _(t):
    f = [None, *[F.col(f"f{k}") for k in range(1, 5)]]
    rules = [((f[1] == 2) | (f[2] == 2), "studies"), (f[3] == 2, "unemployed"), ((f[1] == 1) & (f[2] == 1) & (f[4] == 2), "employed")]
    return t.answers.select(*ID, labels.first_true(rules).alias("occupation"))


@query("q20_cutoff_flag", f"SELECT {ID_SQL}, i1 >= 45 OR i2 >= 9 OR i3 >= 8 OR i4 >= 7 AS problem FROM items")
def _(t):
    return t.items.select(*ID, labels.over_any({"i1": 45, "i2": 9, "i3": 8, "i4": 7}).alias("problem"))


@query("q21_free_text_code", """
    SELECT o_orderkey, CASE WHEN lower(answer) IN ('', '0', '0x') THEN 0 WHEN contains(answer, '+') AND contains(answer, '-') THEN 2
           WHEN contains(answer, '*') OR contains(answer, '+') THEN 1 WHEN contains(lower(answer), 'x') THEN 2
           WHEN contains(answer, '-') THEN 3 ELSE 2 END AS code FROM typed""")
def _(t):
    return t.typed.select("o_orderkey", text.event_code("answer").alias("code"))


@query("q22_adverse_count", f"""
    SELECT {ID_SQL}, coalesce(CAST(a1 = 3 AS INT), 0) + coalesce(CAST(a2 = 3 AS INT), 0) + coalesce(CAST(a3 = 3 AS INT), 0) AS n_adverse FROM answers""")
def _(t):
    total = reduce(lambda a, b: a + b, [text.adverse(c) for c in ("a1", "a2", "a3")])
    return t.answers.select(*ID, total.alias("n_adverse"))


@query("q23_composite", """
    WITH s AS (SELECT avg(i1) AS m1, stddev_samp(i1) AS s1, avg(i4) AS m4, stddev_samp(i4) AS s4, avg(i5) AS m5, stddev_samp(i5) AS s5 FROM items)
    SELECT l_orderkey, l_linenumber, l_partkey, round(((i1 - m1) / s1 + (i4 - m4) / s4 + (i5 - m5) / s5) / 3, 6) AS strain FROM items, s""")
def _(t):
    z = groups.zscore(t.items, ["i1", "i4", "i5"])
    return z.select(*ID, r(scoring.composite(["i1_z", "i4_z", "i5_z"])).alias("strain"))


@query("q24_source_pick", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice WHEN o_orderstatus <> 'F' THEN CAST(o_custkey AS DOUBLE) END AS age FROM orders")
def _(t):
    return t.orders.select("o_orderkey", missing.if_else(F.col("o_orderstatus") == "F", F.col("o_totalprice"), F.col("o_custkey").cast("double")).alias("age"))
