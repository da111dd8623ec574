"""Joins, windows on keys and code linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups, joins, keys, linkage, relinking
from ..session import cut
from ..stats.predictors import number_ranked, prefixes
from .panel import CODE_PARTS
from .registry import query, r, rounded


@query("j1_left_join", """
    SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) ON c_custkey = o_custkey""")
def _(t):
    big = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return t.customer.select("c_custkey").join(big, "c_custkey", "left")


@query("j2_left_join_suffixes", """
    SELECT a.s_suppkey AS key, a.s_acctbal AS s_acctbal_x, b.s_acctbal AS s_acctbal_y
    FROM (SELECT s_suppkey, s_acctbal, s_suppkey + 1 AS next FROM supplier) a LEFT JOIN supplier b ON a.next = b.s_suppkey""")
def _(t):
    a = t.supplier.select(F.col("s_suppkey").alias("key"), "s_acctbal", (F.col("s_suppkey") + 1).alias("next"))
    return joins.join_suffixed(a, t.supplier.select("s_suppkey", "s_acctbal"), "next", "s_suppkey").drop("next")


@query("j3_right_join", """
    SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') RIGHT JOIN customer ON o_custkey = c_custkey""")
def _(t):
    open_orders = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return open_orders.join(t.customer.select("c_custkey"), "c_custkey", "right")


@query("j4_natural_join", "SELECT nk, name, key FROM (SELECT n_nationkey AS nk, n_name AS name FROM nation) NATURAL JOIN (SELECT s_nationkey AS nk, s_suppkey AS key FROM supplier)")
def _(t):
    nation = t.nation.select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("name"))
    return joins.natural_join(t.supplier.select(F.col("s_nationkey").alias("nk"), F.col("s_suppkey").alias("key")), nation).select("nk", "name", "key")


@query("j5_inner_join", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(o, "l_orderkey")


@query("j6_wave_frame", """
    SELECT c_custkey, round(max(avg_price) FILTER (wave = 0), 6) AS avg_price_t0, round(max(avg_price) FILTER (wave = 2), 6) AS avg_price_t2,
           round(max(avg_price) FILTER (wave = 2) - max(avg_price) FILTER (wave = 0), 6) AS avg_price_t2minust0
    FROM panel WHERE wave IN (0, 2) GROUP BY c_custkey HAVING count(DISTINCT wave) = 2""")
def _(t):
    wide = joins.wave_frame(t.panel, "c_custkey", "wave", [0, 2], ["avg_price"])
    return rounded(joins.add_changes(wide, ["avg_price"], 2, 0))


@query("j7_star_join", """
    SELECT a.c_custkey, c_mktsegment, round(a.avg_price, 6) AS price_t0, round(b.avg_price, 6) AS price_t1, round(c.avg_price, 6) AS price_t2
    FROM (SELECT * FROM panel WHERE wave = 0) a JOIN (SELECT c_custkey, avg_price FROM panel WHERE wave = 1) b USING (c_custkey)
    JOIN (SELECT c_custkey, avg_price FROM panel WHERE wave = 2) c USING (c_custkey)""")
def _(t):
    wave = lambda w: t.panel.where(F.col("wave") == w).select("c_custkey", r("avg_price").alias(f"price_t{w}"))
    star = wave(0).join(wave(1), "c_custkey").join(wave(2), "c_custkey")
    return star.join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")


@query("j8_semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    members = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.keep_members(t.orders.select("o_orderkey", "o_custkey"), members, "o_custkey")


@query("j9_anti_join", """
    SELECT l_orderkey, l_linenumber, l_partkey, a1 FROM answers WHERE a1 IS NULL OR a1 NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey IN (1, 5))""")
def _(t):
    bad = t.supplier.where("s_suppkey IN (1, 5)").select(F.col("s_suppkey").cast("int").alias("a1"))
    return joins.drop_members(t.answers.select("l_orderkey", "l_linenumber", "l_partkey", "a1"), bad, "a1")


@query("j9_null_safe_join", """
    SELECT a.a1, a.n AS n_a, b.n AS n_b FROM (SELECT a1, count(*) AS n FROM answers GROUP BY a1) a
    JOIN (SELECT a2, count(*) AS n FROM answers GROUP BY a2) b ON a.a1 IS NOT DISTINCT FROM b.a2""")
def _(t):
    a = groups.group_counts(t.answers, "a1", name="n_a")
    b = groups.group_counts(t.answers, "a2", name="n_b")
    return a.join(b, joins.null_safe_on(a, b, {"a1": "a2"})).select("a1", "n_a", "n_b")


@query("j10_baseline_constants", """
    SELECT c_custkey, wave, round((avg_price - (SELECT avg(avg_price) FROM panel WHERE wave = 0)) / (SELECT stddev_samp(avg_price) FROM panel WHERE wave = 0), 6) AS z
    FROM panel""")
def _(t):
    z = groups.zscore_against(t.panel, t.panel.where("wave = 0"), ["avg_price"])
    return z.select("c_custkey", "wave", r("avg_price_z").alias("z"))


LINK_SQL = """
    WITH pairs AS (
      SELECT n.code AS new, o.code AS old,
             coalesce(CAST(n.w1 = o.w1 AS INT), 0) + coalesce(CAST(n.w2 = o.w2 AS INT), 0) + coalesce(CAST(n.brand = o.brand AS INT), 0)
             + coalesce(CAST(n.kind = o.kind AS INT), 0) + coalesce(CAST(n.size = o.size AS INT), 0) AS concordance
      FROM codes n JOIN codes o ON n.side = 'new' AND o.side = 'old'),
    best AS (SELECT * FROM pairs WHERE concordance > 0 QUALIFY concordance = max(concordance) OVER (PARTITION BY new))
    """


def _sides(t):
    codes = cut(t.codes)
    return codes.where("side = 'new'"), codes.where("side = 'old'")


@query("j11_fuzzy_candidates", LINK_SQL + "SELECT new, old, concordance FROM best")
def _(t):
    new, old = _sides(t)
    best = linkage.best_candidates(new, old, "code", CODE_PARTS)
    return linkage.candidate_pairs(new, old, "code", CODE_PARTS, best)


@query("j11_review_pages", LINK_SQL.replace(" AS concordance\n", """ AS concordance,
             coalesce(CAST(n.w1 = o.w1 AS INT), 0) + 2 * coalesce(CAST(n.w2 = o.w2 AS INT), 0) + 4 * coalesce(CAST(n.brand = o.brand AS INT), 0)
             + 8 * coalesce(CAST(n.kind = o.kind AS INT), 0) + 16 * coalesce(CAST(n.size = o.size AS INT), 0) AS m\n""") + """
    SELECT new, concordance, row_number() OVER (PARTITION BY new ORDER BY m, old) AS nth, old FROM best QUALIFY nth % 10 = 1""")
def _(t):
    # The first candidate of every page of ten, of lists that are never written out.
    new, old = _sides(t)
    best = cut(linkage.best_candidates(new, old, "code", CODE_PARTS))
    lists, members = linkage.review_lists(new, old, "code", CODE_PARTS, best)
    asked = best.where("n_candidates > 0").select("new", F.explode(F.sequence(F.lit(1), F.col("n_candidates"), F.lit(10))).alias("nth"))
    return linkage.candidates_at(cut(lists), members, asked)


@query("j12_auto_accept", LINK_SQL + """
    SELECT new, max(concordance) AS concordance, count(*) AS n_candidates, CASE WHEN count(*) = 1 THEN min(old) END AS old,
           CASE WHEN count(*) = 1 THEN 'auto match' ELSE '' END AS comment FROM best GROUP BY new""")
def _(t):
    new, old = _sides(t)
    return linkage.best_candidates(new, old, "code", CODE_PARTS)


# Decisions a reviewer could have made, taken from the code table by rule.
DECISION_SQL = """
    WITH decisions AS (
      SELECT code AS new, w1 || ' ' || brand || ' ' || kind AS old,
             CASE WHEN row_id % 4 = 1 THEN 'doppelt ' || (row_id - 1) || ' ' || (row_id + 1) ELSE 'auto match' END AS comment,
             CASE WHEN row_id % 8 = 1 THEN CAST(row_id - 1 AS VARCHAR) ELSE CAST(row_id + 1 AS VARCHAR) END AS comment2,
             CASE WHEN row_id % 3 = 0 THEN '-' WHEN row_id % 3 = 1 THEN '+' ELSE '??' END AS decision
      FROM codes WHERE side = 'new'),
    accepted AS (SELECT * FROM decisions WHERE decision IN ('+', '?', '??', '???')),
    invalid AS (SELECT CASE WHEN comment2 = string_split(comment, ' ')[2] THEN string_split(comment, ' ')[3] ELSE string_split(comment, ' ')[2] END AS row_id
                FROM accepted WHERE contains(comment, 'doppelt'))
    """


def _decisions(t):
    row = F.col("row_id")
    return t.codes.where("side = 'new'").select(
        F.col("code").alias("new"), F.concat_ws(" ", "w1", "brand", "kind").alias("old"),
        F.when(row % 4 == 1, F.format_string("doppelt %d %d", row - 1, row + 1)).otherwise("auto match").alias("comment"),
        F.when(row % 8 == 1, (row - 1).cast("string")).otherwise((row + 1).cast("string")).alias("comment2"),
        F.when(row % 3 == 0, "-").when(row % 3 == 1, "+").otherwise("??").alias("decision"),
    )


@query("j13_apply_decisions", DECISION_SQL + """
    SELECT 'new' AS side, row_id, coalesce(a.old, code) AS code FROM codes LEFT JOIN accepted a ON code = a.new WHERE side = 'new'
    UNION ALL SELECT 'old', row_id, code FROM codes WHERE side = 'old' AND CAST(row_id AS VARCHAR) NOT IN (SELECT row_id FROM invalid)""")
def _(t):
    new, old = _sides(t)
    replaced, kept = linkage.apply_decisions(new, old, _decisions(t), "code", "row_id")
    return replaced.unionByName(kept).select("side", "row_id", "code")


@query("j14_relink_after_decisions", DECISION_SQL + """
    , new_keys AS (SELECT coalesce(a.old, code) AS code FROM codes LEFT JOIN accepted a ON code = a.new WHERE side = 'new'),
    old_keys AS (SELECT w1 || ' ' || brand || ' ' || kind AS code FROM codes WHERE side = 'old' AND CAST(row_id AS VARCHAR) NOT IN (SELECT row_id FROM invalid)),
    once AS (SELECT code FROM new_keys GROUP BY code HAVING count(*) = 1),
    counted AS (SELECT code, count(*) AS n FROM old_keys GROUP BY code)
    SELECT once.code, coalesce(n, 0) = 1 AS matched FROM once LEFT JOIN counted USING (code) WHERE coalesce(n, 0) <= 1""")
def _(t):
    new, old = _sides(t)
    replaced, kept = linkage.apply_decisions(new, old, _decisions(t), "code", "row_id")
    short = kept.select(F.concat_ws(" ", "w1", "brand", "kind").alias("code"))
    matched, unmatched = linkage.exact_links(replaced, short, "code")
    return matched.withColumn("matched", F.lit(True)).unionByName(unmatched.withColumn("matched", F.lit(False)))


# Three sheets of decisions and corrections of old rows, by rule, one after the other.
ROUNDS_SQL = LINK_SQL.replace("WITH pairs", """WITH left_open AS (
      SELECT * FROM codes WHERE side = 'new' AND NOT (row_id % 12 IN (1, 3, 5) AND row_id % 7 <> 0)),
    dropped AS (SELECT row_id + CASE WHEN row_id % 8 = 1 THEN 1 ELSE -1 END AS row_id FROM codes
                WHERE side = 'new' AND row_id % 12 IN (1, 3, 5) AND row_id % 7 <> 0 AND row_id % 4 = 1),
    old_rows AS (
      SELECT row_id, CASE WHEN row_id % 20 IN (4, 8, 12) THEN code || ' corrected' ELSE code END AS code,
             CASE WHEN row_id % 20 IN (4, 8, 12) THEN NULL ELSE w1 END AS w1, w2, brand,
             CASE WHEN row_id % 20 IN (4, 8, 12) THEN 'STANDARD TIN' ELSE kind END AS kind, size
      FROM codes WHERE side = 'old' AND row_id NOT IN (SELECT row_id FROM dropped)),
    pairs""").replace("FROM codes n JOIN codes o ON n.side = 'new' AND o.side = 'old')", "FROM left_open n CROSS JOIN old_rows o)")


def _round(t, k: int):
    row = F.col("row_id")
    asked = t.codes.where((F.col("side") == "new") & (row % 12 == 2 * k + 1))
    sheet = asked.select(
        F.col("code").alias("new"), F.lit(None).cast("string").alias("old"),
        F.when(row % 4 == 1, F.format_string("doppelt %d %d", row - 1, row + 1)).otherwise("auto match").alias("comment"),
        F.when(row % 8 == 1, row - 1).otherwise(row + 1).cast("string").alias("comment2"),
        F.when(row % 7 == 0, "-").otherwise("+").alias("decision"))
    fixed = t.codes.where((F.col("side") == "old") & (row % 20 == 4 * k + 4)).select(
        row.alias("no"), F.concat(F.col("code"), F.lit(" corrected")).alias("old"), F.lit(None).cast("string").alias("w1"), "w2", "brand",
        F.lit("STANDARD TIN").alias("kind"), "size")
    return sheet, fixed


@query("j14_relink_three_rounds", ROUNDS_SQL + """
    SELECT code AS new, coalesce(max(concordance), 0) AS concordance, count(old) AS n_candidates, CASE WHEN count(old) = 1 THEN min(old) END AS old
    FROM left_open LEFT JOIN best ON code = new GROUP BY code""")
def _(t):
    new, old = _sides(t)
    links = relinking.start(new, old, "code", "row_id", CODE_PARTS)
    for k in range(3):
        links = relinking.after_review(links, *_round(t, k))
    return links.candidates()


# --- keys and windows ------------------------------------------------------


@query("w1_first_per_key", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""")
def _(t):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    cols = ["l_orderkey", "l_linenumber", *order]
    return keys.first_per_key(t.lineitem.select(*cols), ["l_orderkey", "l_linenumber"], order).drop("l_shipdate", "l_extendedprice")


@query("w2_duplicated_keys", "SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return keys.duplicated_keys(t.lineitem, "l_orderkey", "l_linenumber")


@query("w3_global_z", """
    SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events), 6) AS z FROM events""")
def _(t):
    return groups.zscore(t.events.select("event_id", "value"), ["value"]).select("event_id", r("value_z").alias("z"))


@query("w4_z_within_stratum", """
    SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w, 6) AS z
    FROM customer WINDOW w AS (PARTITION BY c_mktsegment)""")
def _(t):
    z = groups.zscore(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_acctbal"], ["c_mktsegment"])
    return z.select("c_custkey", r("c_acctbal_z").alias("z"))


@query("w5_z_against_baseline", """
    WITH b AS (SELECT avg(n_orders) AS m1, stddev_samp(n_orders) AS s1, avg(max_price) AS m2, stddev_samp(max_price) AS s2 FROM panel WHERE wave = 0)
    SELECT c_custkey, wave, round((n_orders - m1) / s1, 6) AS z_orders, round((max_price - m2) / s2, 6) AS z_max FROM panel, b""")
def _(t):
    z = groups.zscore_against(t.panel, t.panel.where("wave = 0"), ["n_orders", "max_price"])
    return z.select("c_custkey", "wave", r("n_orders_z").alias("z_orders"), r("max_price_z").alias("z_max"))


@query("w6_running_number", """
    SELECT event_id, 'match' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS label FROM events""")
def _(t):
    numbered = keys.running_number(t.events.select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"])
    return numbered.select("event_id", F.concat(F.lit("match"), "rn").alias("label"))


@query("w6_running_number_spread", """
    SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events""")
def _(t):
    # The same operator with the limit on window size set low, as for a hot group.
    rows = t.events.select("event_id", "event_type", "ts")
    return keys.running_number(rows, ["event_type"], ["ts", "event_id"], window_rows=100).select("event_id", F.col("rn").cast("bigint").alias("rn"))


@query("w7_rows_at_maximum", """
    SELECT user_id, event_id, event_type, count(*) OVER (PARTITION BY user_id) AS n_ties FROM (
      SELECT * FROM (SELECT user_id, event_id, event_type, floor(value) AS v FROM events) QUALIFY v = max(v) OVER (PARTITION BY user_id))""")
def _(t):
    rows = t.events.select("user_id", "event_id", "event_type", F.floor("value").alias("v"))
    top = groups.at_extreme(rows, "v", ["user_id"], largest=True)
    ties = groups.group_counts(top, "user_id", name="n_ties")
    return joins.attach_stats(top.drop("v"), ties, ["user_id"])


@query("w8_group_size", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) AS n_group FROM orders")
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    return joins.attach_stats(rows, groups.group_counts(rows, "o_orderpriority", name="n_group"), ["o_orderpriority"]).drop("o_orderpriority")


@query("w9_median_split", """
    SELECT c_custkey, CASE WHEN c_acctbal > m THEN 'high' WHEN c_acctbal <= m THEN 'low' END AS balance_group
    FROM customer, (SELECT median(c_acctbal) AS m FROM customer)""")
def _(t):
    return groups.median_split(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", name="balance_group").drop("c_acctbal")


@query("w9_median_split_grouped", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, i1, CASE WHEN i1 > m THEN 'high' WHEN i1 <= m THEN 'low' END AS i1_group
    FROM items JOIN (SELECT l_suppkey AS k, median(i1) AS m FROM items GROUP BY l_suppkey) ON l_suppkey = k""")
def _(t):
    rows = t.items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "i1")
    return groups.median_split(rows, "i1", ["l_suppkey"])


@query("w9_median_split_per_subject", """
    SELECT c_custkey, wave, CASE WHEN c_acctbal > m THEN 'lag high' WHEN c_acctbal <= m THEN 'lag low' END AS lag_group
    FROM panel, (SELECT median(c_acctbal) AS m FROM (SELECT DISTINCT c_custkey, c_acctbal FROM panel))""")
def _(t):
    rows = t.panel.select("c_custkey", "wave", "c_acctbal")
    return groups.median_split(rows, "c_acctbal", name="lag_group", high="lag high", low="lag low",
                               per="subject", subject="c_custkey").drop("c_acctbal")


@query("w10_above_minimum", "SELECT p_partkey, p_size - min(p_size) OVER (PARTITION BY p_brand) AS above FROM part")
def _(t):
    return groups.above_minimum(t.part.select("p_partkey", "p_brand", "p_size"), "p_size", ["p_brand"], "above").select("p_partkey", "above")


@query("w11_expanding_prefix", """
    SELECT user_id, row, string_agg(event_type, '+' ORDER BY row2) AS formula FROM (
      SELECT a.user_id, a.row, b.event_type, b.row AS row2 FROM ranked a JOIN ranked b ON a.user_id = b.user_id AND b.row <= a.row)
    GROUP BY ALL""".replace("ranked", """(SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS INT) AS row
      FROM events GROUP BY user_id, event_type)"""))
def _(t):
    counts = groups.group_counts(t.events, "user_id", "event_type")
    ranked = number_ranked(counts.select(F.col("user_id").alias("target"), F.col("event_type").alias("predictor"), F.col("n").alias("persistence")))
    return prefixes(ranked).select(F.col("target").alias("user_id"), "row", "formula")
