"""The panel derived from the given tables, in Spark and in SQL.

Customers are subjects, market segments are strata and three spans of order
years are the waves. Line items serve as questionnaire rows, parts as code
words. The given tables hold no missing values, so some are set to NULL by a
rule on the keys, the same in both engines.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import first_true
from ..operators.joins import wave_frame
from ..session import TABLES, load

SCORES = ("n_orders", "avg_price", "max_price")
WAVES = (0, 1, 2)

# Item blocks with the numbers asked and the size of the answer range.
BATTERY = {
    "B039": (range(1, 11), 5),
    "B040": (range(1, 9), 5),
    "FC01": (range(1, 8), 5),
    "PH01": (range(1, 3), 4),
    "ST03": ((1, 2, 9, 15, 16), 4),
    "IU02": ((7, 8, 9, 10, 11, 12, 15, 18, 19, 20, 21, 25), 5),
    "PS01": (range(1, 17), 5),
    "AS01": (range(1, 19), 5),
    "IA01": (range(1, 7), 5),
    "ST02": (range(1, 21), 4),
    "AD01": (range(1, 16), 4),
    "SD01": (range(1, 13), 5),
    "SD04": (range(1, 14), 5),
}


def _battery_items() -> dict[str, str]:
    """Answer of each item as an expression both engines read alike."""
    out = {}
    for b, (block, (numbers, size)) in enumerate(BATTERY.items()):
        for n in numbers:
            a, c, m = 3 + n % 5, 2 + b, 23 + (n * 7 + b) % 17
            answer = f"CAST((o_orderkey * {a} + o_custkey * {c} + {n} * (o_orderkey % 7)) % {size} + 1 AS INT)"
            out[f"{block}_{n:02d}"] = (
                f"CASE WHEN (o_orderkey * 5 + o_custkey + {n}) % {m} = 0 THEN NULL ELSE {answer} END"
            )
    return out


BATTERY_ITEMS = _battery_items()


def _missing(expr: str, k: int) -> str:
    return f"CASE WHEN (l_orderkey * 7 + l_linenumber * {k}) % 11 = 0 THEN NULL ELSE {expr} END"


# Five numeric answers per row, some missing.
ITEMS = {
    "i1": _missing("l_quantity", 1),
    "i2": _missing("l_discount * 100", 2),
    "i3": _missing("l_tax * 100", 3),
    "i4": _missing("CAST(l_linenumber AS DOUBLE)", 4),
    "i5": _missing("CAST(l_suppkey % 5 + 1 AS DOUBLE)", 5),
}
# Answers 1..5 (a1..a8) and flags 1 = no, 2 = yes (f1..f4), some missing.
ANSWERS = {
    **{f"a{k}": _missing(f"CAST((l_partkey + l_linenumber * {k} + l_suppkey * {k}) % 5 + 1 AS INT)", k)
       for k in range(1, 9)},
    **{f"f{k}": _missing(f"CAST((l_partkey * {k} + l_suppkey + l_linenumber) % 2 + 1 AS INT)", k + 3)
       for k in range(1, 5)},
}
ROW_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate"

# Typed answers made of the characters of priority and status.
TYPED = (
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '' "
    "WHEN o_orderkey % 7 = 0 THEN '0' WHEN o_orderkey % 17 = 0 THEN '0x' "
    "WHEN o_orderkey % 5 = 0 THEN '10X' WHEN o_orderkey % 19 = 0 THEN '+-' "
    "WHEN o_orderkey % 3 = 0 THEN '*' WHEN o_orderkey % 23 = 0 THEN '+' "
    "WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'none' END"
)

VIEWS = {
    "panel": """
        SELECT c_custkey, c_mktsegment, c_acctbal,
               CASE WHEN year(o_orderdate) <= 1996 THEN 0 WHEN year(o_orderdate) <= 1998 THEN 1 ELSE 2 END AS wave,
               count(*) AS n_orders, avg(o_totalprice) AS avg_price, max(o_totalprice) AS max_price,
               min(o_orderdate) AS first_date
        FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL""",
    "wide": """
        SELECT c_custkey, c_mktsegment, c_acctbal,
               max(n_orders) FILTER (wave = 0) AS n_orders_t0, max(n_orders) FILTER (wave = 1) AS n_orders_t1,
               max(n_orders) FILTER (wave = 2) AS n_orders_t2,
               max(avg_price) FILTER (wave = 0) AS avg_price_t0, max(avg_price) FILTER (wave = 1) AS avg_price_t1,
               max(avg_price) FILTER (wave = 2) AS avg_price_t2,
               max(max_price) FILTER (wave = 0) AS max_price_t0, max(max_price) FILTER (wave = 1) AS max_price_t1,
               max(max_price) FILTER (wave = 2) AS max_price_t2
        FROM panel GROUP BY ALL HAVING count(DISTINCT wave) = 3""",
    "items": "SELECT " + ROW_ID + ", " + ", ".join(f"{e} AS {n}" for n, e in ITEMS.items()) + " FROM lineitem",
    "answers": "SELECT " + ROW_ID + ", " + ", ".join(f"{e} AS {n}" for n, e in ANSWERS.items()) + " FROM lineitem",
    "survey": "SELECT o_orderkey, o_custkey, " + ", ".join(f"{e} AS {n}" for n, e in BATTERY_ITEMS.items())
              + " FROM orders",
    "typed": f"SELECT o_orderkey, {TYPED} AS answer FROM orders",
    "codes": """
        SELECT p_partkey AS row_id, CASE WHEN p_partkey % 2 = 1 THEN 'new' ELSE 'old' END AS side,
               p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size || ' ' || p_partkey AS code,
               split_part(p_name, ' ', 1) AS w1,
               CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE split_part(p_name, ' ', 2) END AS w2,
               p_brand AS brand, p_type AS kind, CAST(p_size AS VARCHAR) AS size
        FROM part""",
    "twins": """
        SELECT c_custkey, c_mktsegment, c_acctbal, avg(o_totalprice) AS avg_price,
               CAST(count(*) AS DOUBLE) AS n_orders, c_custkey % 5 = 0 AS treated
        FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL""",
    "twins6": """
        SELECT c_custkey, c_mktsegment, c_acctbal, avg(o_totalprice) AS avg_price, CAST(count(*) AS DOUBLE) AS n_orders,
               max(o_totalprice) AS max_price, min(o_totalprice) AS min_price,
               CAST(date_diff('day', DATE '1990-01-01', CAST(min(o_orderdate) AS DATE)) AS DOUBLE) AS first_day, c_custkey % 5 = 0 AS treated
        FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL""",
    # Every eligible pair, by brute force; the Spark plan never forms these.
    "twin_sds": """
        SELECT c_mktsegment, stddev_samp(c_acctbal) AS sd1, stddev_samp(avg_price) AS sd2 FROM twins GROUP BY c_mktsegment""",
    "twin_pairs": """
        SELECT a.c_mktsegment AS stratum, a.c_custkey AS treated, b.c_custkey AS control,
               greatest(abs(a.c_acctbal - b.c_acctbal) / sd1, abs(a.avg_price - b.avg_price) / sd2) AS needed,
               pow((a.c_acctbal - b.c_acctbal) / sd1, 2) + pow((a.avg_price - b.avg_price) / sd2, 2) AS dist
        FROM twins a JOIN twins b ON a.c_mktsegment = b.c_mktsegment AND a.treated AND NOT b.treated
        JOIN twin_sds s ON s.c_mktsegment = a.c_mktsegment""",
    "twin_ties": """
        SELECT CAST(c AS INT) AS caliper, p.* FROM twin_pairs p JOIN (SELECT unnest(range(25, 101, 5)) AS c) ON needed <= c / 100.0
        QUALIFY dist <= min(dist) OVER (PARTITION BY c, treated) + 1e-5""",
    "twin_first": """
        SELECT caliper, stratum, treated, min(control) AS control, count(*) AS n_ties, min(dist) AS dist FROM twin_ties GROUP BY ALL""",
    "twin_devs": """
        SELECT f.*, x.c_acctbal AS c_acctbal_x, y.c_acctbal AS c_acctbal_y, x.avg_price AS avg_price_x, y.avg_price AS avg_price_y,
               abs(x.c_acctbal - y.c_acctbal) AS c_acctbal_dev, abs(x.avg_price - y.avg_price) AS avg_price_dev,
               abs(x.c_acctbal - y.c_acctbal) / sd1 AS c_acctbal_devz, abs(x.avg_price - y.avg_price) / sd2 AS avg_price_devz
        FROM twin_first f JOIN twins x ON f.treated = x.c_custkey JOIN twins y ON f.control = y.c_custkey
        JOIN twin_sds s ON s.c_mktsegment = f.stratum""",
}

CODE_PARTS = ("w1", "w2", "brand", "kind", "size")
COVARIATES = ("c_acctbal", "avg_price")
SIX_COVARIATES = (*COVARIATES, "n_orders", "max_price", "min_price", "first_day")


class Tables:
    """The given tables and those derived from them, read when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return load(self.spark, self.sf_dir, name)
        raise AttributeError(name)

    @cached_property
    def panel(self) -> DataFrame:
        """One row per subject and wave. Orders are reduced before the join."""
        year = F.year("o_orderdate")
        wave = first_true([(year <= 1996, 0), (year <= 1998, 1)], 2)
        scores = self.orders.groupBy(F.col("o_custkey").alias("c_custkey"), wave.alias("wave")).agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.avg("o_totalprice").alias("avg_price"),
            F.max("o_totalprice").alias("max_price"),
            F.min("o_orderdate").alias("first_date"),
        )
        subjects = self.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
        return scores.join(subjects, "c_custkey")

    @cached_property
    def wide(self) -> DataFrame:
        """One row per subject seen at all three waves."""
        frame = wave_frame(self.panel, "c_custkey", "wave", WAVES, SCORES)
        return frame.join(self.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), "c_custkey")

    @cached_property
    def items(self) -> DataFrame:
        ids = ROW_ID.split(", ")
        return self.lineitem.selectExpr(*ids, *[f"{e} AS {n}" for n, e in ITEMS.items()])

    @cached_property
    def answers(self) -> DataFrame:
        ids = ROW_ID.split(", ")
        return self.lineitem.selectExpr(*ids, *[f"{e} AS {n}" for n, e in ANSWERS.items()])

    @cached_property
    def survey(self) -> DataFrame:
        return self.orders.selectExpr(
            "o_orderkey", "o_custkey", *[f"{e} AS {n}" for n, e in BATTERY_ITEMS.items()]
        )

    @cached_property
    def typed(self) -> DataFrame:
        return self.orders.select("o_orderkey", F.expr(TYPED).alias("answer"))

    @cached_property
    def codes(self) -> DataFrame:
        word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
        size = F.col("p_size").cast("string")
        return self.part.select(
            F.col("p_partkey").alias("row_id"),
            F.when(F.col("p_partkey") % 2 == 1, "new").otherwise("old").alias("side"),
            F.concat_ws(" ", "p_name", "p_brand", "p_type", size, F.col("p_partkey").cast("string")).alias("code"),
            word(1).alias("w1"),
            F.when(F.col("p_partkey") % 37 != 0, word(2)).alias("w2"),
            F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), size.alias("size"),
        )

    @cached_property
    def twins(self) -> DataFrame:
        totals = self.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.avg("o_totalprice").alias("avg_price"), F.count(F.lit(1)).cast("double").alias("n_orders")
        )
        subjects = self.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
        return subjects.join(totals, "c_custkey").withColumn("treated", F.col("c_custkey") % 5 == 0)

    @cached_property
    def twins6(self) -> DataFrame:
        first_day = F.datediff(F.min("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("double")
        totals = self.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.avg("o_totalprice").alias("avg_price"), F.count(F.lit(1)).cast("double").alias("n_orders"),
            F.max("o_totalprice").alias("max_price"), F.min("o_totalprice").alias("min_price"), first_day.alias("first_day"),
        )
        subjects = self.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
        return subjects.join(totals, "c_custkey").withColumn("treated", F.col("c_custkey") % 5 == 0)
