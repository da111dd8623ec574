"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import composite
from ..operators import groups, joins, keys, reshape
from ..operators.quantiles import quantiles
from ..stats import ttests
from .panel import SCORES
from .registry import query, r, rounded
from .sql_stats import NORMAL, p_t


def _avgs(*cols: str) -> str:
    return ", ".join(f"round(avg({c}), 4) AS {c}_m, round(stddev_samp({c}), 4) AS {c}_sd" for c in cols)


@query("flagship_change_by_segment", """
    WITH b AS (SELECT avg(n_orders) AS m1, stddev_samp(n_orders) AS s1, avg(avg_price) AS m2, stddev_samp(avg_price) AS s2,
                      avg(max_price) AS m3, stddev_samp(max_price) AS s3 FROM panel WHERE wave = 0),
    strain AS (SELECT c_custkey, c_mktsegment, wave, ((n_orders - m1) / s1 + (avg_price - m2) / s2 + (max_price - m3) / s3) / 3 AS strain FROM panel, b),
    change AS (SELECT c_mktsegment, max(strain) FILTER (wave = 2) - max(strain) FILTER (wave = 0) AS d
               FROM strain WHERE wave IN (0, 2) GROUP BY c_custkey, c_mktsegment HAVING count(*) = 2)
    {half}""".format(half=f"""
    SELECT c_mktsegment, n, round(m, 6) AS m, round(sd, 6) AS sd, round(m / (sd / sqrt(n)), 6) AS t, CAST(n - 1 AS DOUBLE) AS df, round(m / sd, 6) AS d,
           round(m / sd - {NORMAL} * sqrt(1.0 / n + pow(m / sd, 2) / (2 * n)), 6) AS d_lo,
           round(m / sd + {NORMAL} * sqrt(1.0 / n + pow(m / sd, 2) / (2 * n)), 6) AS d_hi, round({p_t('(m / (sd / sqrt(n)))', '(n - 1)')}, 6) AS p
    FROM (SELECT c_mktsegment, count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd FROM change GROUP BY c_mktsegment)"""))
def _(t):
    z = groups.zscore_against(t.panel, t.panel.where("wave = 0"), SCORES)
    strain = z.select("c_custkey", "wave", composite([f"{s}_z" for s in SCORES]).alias("strain"))
    wide = joins.wave_frame(strain, "c_custkey", "wave", [0, 2], ["strain"])
    tagged = wide.join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")
    out = ttests.paired(tagged, [("strain_t2", "strain_t0")], ["c_mktsegment"])
    return rounded(out.drop("variable"))


@query("a1_time_summary", """
    SELECT round(min(epoch_us(l_shipdate)) / 1e6, 3) AS min, round(avg(epoch_us(l_shipdate)) / 1e6, 1) AS mean,
           round(median(epoch_us(l_shipdate)) / 1e6, 3) AS median, round(max(epoch_us(l_shipdate)) / 1e6, 3) AS max FROM lineitem""")
def _(t):
    return rounded(groups.time_summary(t.lineitem, "l_shipdate"), 3, mean=1)


@query("a2_time_summary_per_wave", """
    SELECT time, round(min(s), 3) AS min, round(avg(s), 1) AS mean, round(median(s), 3) AS median, round(max(s), 3) AS max FROM (
      SELECT 'ship' AS time, epoch_us(l_shipdate) / 1e6 AS s FROM lineitem
      UNION ALL SELECT 'order', epoch_us(o_orderdate) / 1e6 FROM orders) GROUP BY time""")
def _(t):
    ship = t.lineitem.select(F.col("l_shipdate").alias("ship"))
    order = t.orders.select(F.col("o_orderdate").alias("order"))
    both = ship.unionByName(order, allowMissingColumns=True)
    long = reshape.to_long(both, [], ["ship", "order"], "time", "stamp").where("stamp IS NOT NULL")
    return rounded(groups.time_summary(long, "stamp", ["time"]), 3, mean=1)


@query("a3_counts", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    return groups.group_counts(t.orders, "o_orderpriority", "o_orderstatus")


@query("a4_present_counts", "SELECT count(i1) AS i1, count(i2) AS i2, count(i3) AS i3, count(i4) AS i4, count(i5) AS i5 FROM items")
def _(t):
    return groups.present_counts(t.items, ["i1", "i2", "i3", "i4", "i5"])


@query("a5_frequency", "SELECT a1, count(*) AS n FROM answers WHERE a1 IS NOT NULL GROUP BY a1")
def _(t):
    return groups.frequency(t.answers, "a1")


@query("a5_frequency_with_missing", "SELECT a2, count(*) AS n FROM answers GROUP BY a2")
def _(t):
    return groups.frequency(t.answers, "a2", with_missing=True)


@query("a6_category_summary", "SELECT answer, count(*) AS n FROM typed GROUP BY answer")
def _(t):
    return groups.frequency(t.typed, "answer", with_missing=True)


@query("a6_logical_summary", "SELECT a1 > 3 AS high, count(*) AS n FROM answers GROUP BY ALL")
def _(t):
    return groups.frequency(t.answers.select((F.col("a1") > 3).alias("high")), "high", with_missing=True)


@query("a7_six_numbers", """
    SELECT variable, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q25, round(median(v), 6) AS median, round(avg(v), 6) AS mean,
           round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS max, count(*) FILTER (v IS NULL) AS n_missing
    FROM (SELECT 'i1' AS variable, i1 AS v FROM items UNION ALL SELECT 'i2', i2 FROM items UNION ALL SELECT 'l_quantity', l_quantity FROM items)
    GROUP BY variable""")
def _(t):
    return rounded(groups.six_numbers(t.items, ["i1", "i2", "l_quantity"]))


@query("a7_six_numbers_grouped", """
    SELECT 'o_totalprice' AS variable, o_orderpriority, round(min(o_totalprice), 4) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q25,
           round(median(o_totalprice), 4) AS median, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.75), 4) AS q75,
           round(max(o_totalprice), 4) AS max, count(*) FILTER (o_totalprice IS NULL) AS n_missing FROM orders GROUP BY o_orderpriority""")
def _(t):
    return rounded(groups.six_numbers(t.orders, ["o_totalprice"], ["o_orderpriority"]), 4)


@query("a7_quantiles_by_counting", """
    SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.1), 4) AS q10, round(median(o_totalprice), 4) AS q50,
           round(quantile_cont(o_totalprice, 0.95), 4) AS q95 FROM orders GROUP BY o_orderpriority""")
def _(t):
    # The path for groups too large for one task, used here at any size.
    q = quantiles(t.orders, "o_totalprice", [0.1, 0.5, 0.95], ["o_orderpriority"])
    return q.select("o_orderpriority", "n", *[r(F.col("q")[i], 4).alias(n) for i, n in enumerate(["q10", "q50", "q95"])])


@query("a8_proportion", """
    SELECT round(avg(CAST(a1 >= 3 AS DOUBLE)), 6) AS cutoff, round(avg(CAST(a2 > 1 AS DOUBLE)), 6) AS some FROM answers""")
def _(t):
    return rounded(t.answers.agg(groups.share(F.col("a1") >= 3).alias("cutoff"), groups.share(F.col("a2") > 1).alias("some")))


@query("a9_mean_sd_many", f"SELECT {_avgs('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax')} FROM lineitem")
def _(t):
    return rounded(groups.mean_sd(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 4)


@query("a10_ranges", """
    SELECT 'min' AS bound, min(n_orders) AS n_orders, min(avg_price) AS avg_price, min(max_price) AS max_price FROM p UNION ALL
    SELECT 'max', max(n_orders), max(avg_price), max(max_price) FROM p""".replace(" p", " (SELECT n_orders, round(avg_price, 4) AS avg_price, max_price FROM panel)"))
def _(t):
    return rounded(groups.ranges(t.panel, list(SCORES)), 4)


@query("a11_group_means", """
    SELECT o_custkey IS NOT NULL AS stayed, count(*) AS n, round(avg(c_acctbal), 4) AS c_acctbal, round(avg(c_nationkey), 6) AS c_nationkey
    FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey GROUP BY ALL""")
def _(t):
    big = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    flagged = keys.flag_members(t.customer, big, "c_custkey", "stayed")
    return rounded(groups.group_means(flagged, ["c_acctbal", "c_nationkey"], ["stayed"]), 6, c_acctbal=4)


@query("a12_standard_error", """
    SELECT l_returnflag, round(stddev_samp(i1) / sqrt(count(i1)), 8) AS se, round(stddev_samp(i1) / sqrt(count(*)), 8) AS se_all
    FROM (SELECT i.i1, l.l_returnflag FROM (SELECT l_returnflag, CASE WHEN (l_orderkey * 7 + l_linenumber * 1) % 11 = 0 THEN NULL ELSE l_quantity END AS i1 FROM lineitem) l,
          LATERAL (SELECT l.i1) i) GROUP BY l_returnflag""")
def _(t):
    rows = t.lineitem.select("l_returnflag", F.when((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 11 != 0, F.col("l_quantity")).alias("i1"))
    return rounded(rows.groupBy("l_returnflag").agg(
        groups.std_error("i1").alias("se"), groups.std_error("i1", skip_missing=False).alias("se_all")), 8)


CELL_SQL = """count({v}) AS n, round(avg({v}), 4) AS mean, round(stddev_samp({v}) / sqrt(count({v})), 4) AS se,
           round(avg({v}) - 1.96 * stddev_samp({v}) / sqrt(count({v})), 4) AS lo, round(avg({v}) + 1.96 * stddev_samp({v}) / sqrt(count({v})), 4) AS hi"""


@query("a13_cell_means", f"""
    SELECT wave, balance_group, c_mktsegment, {CELL_SQL.format(v='avg_price')}
    FROM (SELECT p.*, CASE WHEN c_acctbal > (SELECT median(c_acctbal) FROM panel) THEN 'high' ELSE 'low' END AS balance_group FROM panel p)
    GROUP BY wave, balance_group, c_mktsegment""")
def _(t):
    rows = groups.median_split(t.panel, "c_acctbal", name="balance_group")
    return rounded(groups.cell_means(rows, "avg_price", ["wave", "balance_group", "c_mktsegment"]), 4)


@query("a14_long_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, c_mktsegment, round(avg({c}), 4) AS m, round(stddev_samp({c}), 4) AS sd, round(min({c}), 4) AS min, round(max({c}), 4) AS max FROM wide GROUP BY c_mktsegment"
    for c in ("avg_price_t0", "avg_price_t2", "c_acctbal")))
def _(t):
    return rounded(groups.long_summary(t.wide, ["avg_price_t0", "avg_price_t2", "c_acctbal"], ["c_mktsegment"]), 4)


@query("a15_sd_grid", " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, c_mktsegment, round(avg({c}), 6) AS m, round(stddev_samp({c}), 4) AS sd, round(stddev_samp({c}) * 2 / 3, 4) AS sd_2_3,
        round(stddev_samp({c}) * 0.55, 4) AS sd_055, round(stddev_samp({c}) / 2, 4) AS sd_1_2, round(stddev_samp({c}) / 3, 4) AS sd_1_3,
        round(stddev_samp({c}) / 4, 4) AS sd_1_4 FROM twins GROUP BY c_mktsegment""" for c in ("c_acctbal", "avg_price")))
def _(t):
    return rounded(groups.sd_grid(t.twins, ["c_acctbal", "avg_price"], ["c_mktsegment"]), 4, m=6)


@query("a15_sd_grid_floored", " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, c_mktsegment, round(avg({c}), 6) AS m, CAST(floor(stddev_samp({c})) AS BIGINT) AS sd,
        CAST(floor(stddev_samp({c}) * 2 / 3) AS BIGINT) AS sd_2_3, CAST(floor(stddev_samp({c}) * CAST(0.55 AS DOUBLE)) AS BIGINT) AS sd_055,
        CAST(floor(stddev_samp({c}) / 2) AS BIGINT) AS sd_1_2, CAST(floor(stddev_samp({c}) / 3) AS BIGINT) AS sd_1_3,
        CAST(floor(stddev_samp({c}) / 4) AS BIGINT) AS sd_1_4 FROM twins GROUP BY c_mktsegment""" for c in ("c_acctbal", "avg_price")))
def _(t):
    return rounded(groups.sd_grid(t.twins, ["c_acctbal", "avg_price"], ["c_mktsegment"], floored=True), 4, m=6)


@query("a16_two_level_mean", """
    SELECT c_mktsegment, count(*) AS n, round(avg(avg_price), 4) AS avg_price
    FROM (SELECT c_custkey, c_mktsegment, avg(avg_price) AS avg_price FROM panel GROUP BY ALL) GROUP BY c_mktsegment""")
def _(t):
    return rounded(groups.two_level_mean(t.panel, "avg_price", ["c_custkey", "c_mktsegment"], ["c_mktsegment"]), 4)


@query("a17_share_of_parent", """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS n_group,
           round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 8) AS gsize FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def _(t):
    return rounded(groups.parent_share(t.orders, ["o_orderstatus", "o_orderpriority"], ["o_orderstatus"]), 8)


@query("a19_means_wide", """
    SELECT c_mktsegment, treated, round(avg(c_acctbal), 4) AS c_acctbal, round(avg(avg_price), 4) AS avg_price, round(avg(n_orders), 6) AS n_orders
    FROM twins GROUP BY ALL""")
def _(t):
    cols = ["c_acctbal", "avg_price", "n_orders"]
    long = reshape.to_long(t.twins, ["c_mktsegment", "treated"], cols)
    means = long.groupBy("variable", "c_mktsegment", "treated").agg(F.avg("value").alias("m"))
    return rounded(reshape.to_wide(means, ["c_mktsegment", "treated"], "variable", "m", cols), 4, n_orders=6)


@query("a20_norm_z", """
    SELECT round(avg(l_quantity), 6) AS m, round(stddev_samp(l_quantity), 6) AS sd, round((avg(l_quantity) - 29.43) / 5.36, 6) AS z FROM lineitem""")
def _(t):
    # Mean and SD of the published norm.
    return rounded(groups.norm_z(t.lineitem, "l_quantity", 29.43, 5.36))


@query("a21_rescaled_mean_sd", "SELECT round(avg(l_discount * 22), 6) AS m, round(stddev_samp(l_discount * 22), 6) AS sd FROM lineitem")
def _(t):
    # Fixed value: number of items behind the mean score.
    return rounded(groups.rescaled_mean_sd(t.lineitem, "l_discount", 22))


@query("a22_grouped_mean_sd_sorted", """
    SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice / 365), 6) AS years_m, round(stddev_samp(o_totalprice / 365), 6) AS years_sd
    FROM orders GROUP BY ALL ORDER BY 1, 2""")
def _(t):
    scaled = t.orders.withColumn("years", F.col("o_totalprice") / 365)
    out = groups.mean_sd(scaled, ["years"], ["o_orderstatus", "o_orderpriority"])
    return rounded(groups.ordered(out, {"o_orderstatus": "asc", "o_orderpriority": "asc"}))


@query("a23_extreme_scalars", "SELECT max(p_size) AS top, min(p_retailprice) AS low FROM part")
def _(t):
    return t.part.agg(F.max("p_size").alias("top"), F.min("p_retailprice").alias("low"))


@query("a24_group_mean", "SELECT event_type, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def _(t):
    return rounded(t.events.groupBy("event_type").agg(F.avg("value").alias("value")))
