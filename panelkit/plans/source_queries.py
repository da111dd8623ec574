"""Readers and writers: the given tables written in each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import linkage
from ..session import load, scratch_path
from ..sources import quoted, readers, writers
from .join_queries import LINK_SQL, _sides
from .panel import CODE_PARTS
from .registry import query

ORDERS = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("answer", T.StringType()),
])
ORDERS_SQL = "SELECT o_orderkey, o_totalprice / 7 AS o_totalprice, o_orderstatus, nullif(answer, '') AS answer FROM orders JOIN typed USING (o_orderkey)"
# Real text with line breaks, quotes and separators.
TEXTS_SQL = "SELECT doc_id, nullif(text, '') AS text, n_chars / 7.0::DOUBLE AS share FROM documents"
TEXTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("share", T.DoubleType()),
])


def _texts(t):
    return load(t.spark, t.sf_dir, "documents").select(
        F.col("doc_id").cast("bigint"), F.nullif("text", F.lit("")).alias("text"), (F.col("n_chars") / 7).alias("share"))


def _orders(t):
    typed = t.typed.withColumn("answer", F.nullif("answer", F.lit("")))
    rows = t.orders.join(typed, "o_orderkey").withColumn("o_totalprice", F.col("o_totalprice") / 7)
    return rows.select(*ORDERS.names)


@query("s1_decimal_comma_csv", ORDERS_SQL)
def _(t):
    path = scratch_path(t.spark, "decimal-comma")
    writers.write_decimal_comma_csv(_orders(t), path)
    return readers.read_decimal_comma_csv(t.spark, path, ORDERS, escaped=True)


@query("s1_texts_decimal_comma_csv", TEXTS_SQL)
def _(t):
    path = scratch_path(t.spark, "texts")
    writers.write_decimal_comma_csv(_texts(t), path)
    return readers.read_decimal_comma_csv(t.spark, path, TEXTS, escaped=True)


@query("s1_quoted_line_breaks", TEXTS_SQL)
def _(t):
    path = scratch_path(t.spark, "quoted")
    writers.write_quoted(_texts(t), path)
    return quoted.read_quoted(t.spark, path, TEXTS)[0]


@query("s2_texts_utf16_tsv", TEXTS_SQL)
def _(t):
    path = scratch_path(t.spark, "texts-utf16")
    writers.write_tsv(_texts(t), path, "UTF-16LE")
    return readers.read_tsv(t.spark, path, TEXTS, "UTF-16LE", escaped=True)


@query("s3_texts_tsv", TEXTS_SQL)
def _(t):
    path = scratch_path(t.spark, "texts-tsv")
    writers.write_tsv(_texts(t), path)
    return readers.read_tsv(t.spark, path, TEXTS, escaped=True)


@query("s2_utf16_tsv", "SELECT c_custkey, c_name || ' Größe' AS name FROM customer")
def _(t):
    path = scratch_path(t.spark, "utf16")
    writers.write_tsv(t.customer.select("c_custkey", F.concat("c_name", F.lit(" Größe")).alias("name")), path, "UTF-16LE")
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("name", T.StringType())])
    return readers.read_tsv(t.spark, path, schema, "UTF-16LE", escaped=True)


@query("s3_utf8_tsv", ORDERS_SQL)
def _(t):
    path = scratch_path(t.spark, "tsv")
    writers.write_tsv(_orders(t), path)
    return readers.read_tsv(t.spark, path, ORDERS, escaped=True)


@query("s4_decode_labels", "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    book = t.nation.select(F.lit("c_nationkey").alias("variable"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    return readers.decode_labels(t.customer.select("c_custkey", "c_nationkey"), book, "c_nationkey", "nation").select("c_custkey", "nation")


@query("s4_decode_all_columns", """
    SELECT c_custkey, n_name AS c_nationkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'segment ' || c_mktsegment END AS c_mktsegment
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    nations = t.nation.select(F.lit("c_nationkey").alias("variable"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"))
    segments = t.customer.where("c_mktsegment <> 'BUILDING'").select(
        F.lit("c_mktsegment").alias("variable"), F.col("c_mktsegment").alias("code"), F.concat(F.lit("segment "), "c_mktsegment").alias("label")).distinct()
    rows = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    return readers.decode_columns(rows, nations.unionByName(segments), ["c_nationkey", "c_mktsegment"])[0]


@query("s5_raw_codes", "SELECT c_custkey, c_nationkey FROM customer")
def _(t):
    return readers.read_codes(t.spark, f"{t.sf_dir}/customer.parquet", ["c_custkey", "c_nationkey"])


@query("s6_decision_sheet", """
    SELECT code AS new, brand AS old, CAST(row_id % 6 AS INT) AS concordance, 'doppelt ' || row_id AS comment, kind AS comment2,
           CASE WHEN row_id % 3 = 0 THEN '-' ELSE '??' END AS decision FROM codes""")
def _(t):
    row = F.col("row_id")
    sheet = t.codes.select(
        F.col("code").alias("new"), F.col("brand").alias("old"), (row % 6).cast("int").alias("concordance"),
        F.concat(F.lit("doppelt "), row).alias("comment"), F.col("kind").alias("comment2"),
        F.when(row % 3 == 0, "-").otherwise("??").alias("decision"),
    )
    path = scratch_path(t.spark, "decisions")
    writers.write_decimal_comma_csv(sheet, path)
    return readers.read_decisions(t.spark, path, escaped=True)


@query("s7_literal_table", """
    SELECT event_type, weight, count(*) AS n FROM events JOIN (VALUES ('click', 1), ('view', 2), ('error', 3)) v(event_type, weight) USING (event_type) GROUP BY ALL""")
def _(t):
    literal = t.spark.createDataFrame([("click", 1), ("view", 2), ("error", 3)], "event_type string, weight int")
    return t.events.join(F.broadcast(literal), "event_type").groupBy("event_type", "weight").agg(F.count(F.lit(1)).alias("n"))


@query("s8_candidate_files", LINK_SQL + "SELECT new, old, concordance FROM best")
def _(t):
    new, old = _sides(t)
    best = linkage.best_candidates(new, old, "code", CODE_PARTS)
    path = scratch_path(t.spark, "candidates")
    writers.write_review_lists(*linkage.review_lists(new, old, "code", CODE_PARTS, best), path)
    return linkage.expand(*readers.read_review_lists(t.spark, path))


@query("s9_snapshot", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def _(t):
    return writers.write_snapshot(t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), scratch_path(t.spark, "snapshot"))
