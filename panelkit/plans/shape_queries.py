"""Wide, long and one-hot forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reshape
from .registry import query, rounded

ITEM_COLS = ["i1", "i2", "i3", "i4", "i5"]
PHASES = {0: "Pre", 1: "Peak", 2: "Downturn"}


@query("r1_wide_to_long", """
    SELECT l_orderkey, l_linenumber, l_partkey, variable, value FROM
    (SELECT l_orderkey, l_linenumber, l_partkey, i1, i2, i3, i4, i5 FROM items) UNPIVOT INCLUDE NULLS (value FOR variable IN (i1, i2, i3, i4, i5))""")
def _(t):
    return reshape.to_long(t.items, ["l_orderkey", "l_linenumber", "l_partkey"], ITEM_COLS)


@query("r2_long_to_wide", """
    SELECT c_custkey, round(max(avg_price) FILTER (wave = 0), 6) AS w0, round(max(avg_price) FILTER (wave = 1), 6) AS w1,
           round(max(avg_price) FILTER (wave = 2), 6) AS w2 FROM panel GROUP BY c_custkey""")
def _(t):
    return rounded(reshape.to_wide(t.panel, ["c_custkey"], "wave", "avg_price", [0, 1, 2], prefix="w"))


@query("r3_long_to_wide_filled", """
    SELECT l_suppkey, coalesce(max(v) FILTER (l_returnflag = 'A'), CASE WHEN count(*) FILTER (l_returnflag = 'A') = 0 THEN 0 END) AS A,
           coalesce(max(v) FILTER (l_returnflag = 'R'), CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 0 END) AS R,
           coalesce(max(v) FILTER (l_returnflag = 'X'), CASE WHEN count(*) FILTER (l_returnflag = 'X') = 0 THEN 0 END) AS X
    FROM (SELECT l_suppkey, l_returnflag, CASE WHEN l_suppkey % 3 <> 0 THEN max(l_quantity) END AS v FROM lineitem GROUP BY l_suppkey, l_returnflag) GROUP BY l_suppkey""")
def _(t):
    cells = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.max("l_quantity").alias("v"))
    cells = cells.withColumn("v", F.when(F.col("l_suppkey") % 3 != 0, F.col("v")))
    return reshape.to_wide(cells, ["l_suppkey"], "l_returnflag", "v", ["A", "R", "X"], fill=0.0)


@query("r4_one_hot", """
    SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS o_orderstatus_F, CAST(o_orderstatus = 'O' AS INT) AS o_orderstatus_O,
           CAST(o_orderstatus = 'P' AS INT) AS o_orderstatus_P FROM orders""")
def _(t):
    return reshape.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query("r4_one_hot_sparse", """
    SELECT o_orderkey, (SELECT count(DISTINCT o_custkey) FROM orders)::INT AS size, (dense_rank() OVER (ORDER BY o_custkey) - 1)::INT AS at, 1.0::DOUBLE AS value
    FROM orders""")
def _(t):
    rows, _ = reshape.one_hot_sparse(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "v")
    return rows.select("o_orderkey", "v.size", F.col("v.indices")[0].alias("at"), F.col("v.values")[0].alias("value"))


@query("r4_one_hot_with_missing", """
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce(f1 = 1, false) AS INT) AS f1_1, CAST(coalesce(f1 = 2, false) AS INT) AS f1_2,
           CAST(f1 IS NULL AS INT) AS f1_NA FROM answers""")
def _(t):
    return reshape.one_hot(t.answers.select("l_orderkey", "l_linenumber", "l_partkey", "f1"), "f1")


@query("r5_waves_to_long", """
    SELECT c_custkey, CAST(substr(name, 12) AS INT) AS time, CASE substr(name, 12) WHEN '0' THEN 'Pre' WHEN '1' THEN 'Peak' ELSE 'Downturn' END AS phase,
           round(v, 6) AS avg_price FROM (SELECT c_custkey, avg_price_t0, avg_price_t1, avg_price_t2 FROM wide)
    UNPIVOT (v FOR name IN (avg_price_t0, avg_price_t1, avg_price_t2))""")
def _(t):
    return rounded(reshape.waves_to_long(t.wide, ["c_custkey"], "avg_price", PHASES))


@query("r6_gap_in_days", """
    SELECT c_custkey, round((epoch_us(max(first_date) FILTER (wave = 2)) - epoch_us(max(first_date) FILTER (wave = 0))) / 86400e6, 6) AS days
    FROM panel WHERE wave IN (0, 2) GROUP BY c_custkey""")
def _(t):
    return rounded(reshape.gap_in_days(t.panel, "c_custkey", "wave", "first_date", 2, 0))
