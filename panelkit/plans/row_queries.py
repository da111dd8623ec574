"""Projections, filters, scalar functions, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, labels, missing, numeric, text
from ..operators import filters, groups, keys, reshape
from ..operators import select as sel
from .registry import query, r, rounded

# --- projections -----------------------------------------------------------


@query("p1_project_rename", "SELECT c_custkey AS subject, c_mktsegment AS stratum, c_acctbal AS balance FROM customer")
def _(t):
    return t.customer.select(
        F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("stratum"),
        F.col("c_acctbal").alias("balance"),
    )


@query("p2_select_pattern", """
    SELECT c_custkey, avg_price_t0, avg_price_t1, avg_price_t2, n_orders_t0, max_price_t0 FROM (
      SELECT c_custkey, round(avg_price_t0, 6) AS avg_price_t0, round(avg_price_t1, 6) AS avg_price_t1,
             round(avg_price_t2, 6) AS avg_price_t2, n_orders_t0, max_price_t0 FROM wide)""")
def _(t):
    scores = (sel.starts_with("AVG") & sel.contains("price")) | (sel.ends_with("_t0") & ~sel.contains("acct"))
    return rounded(sel.select(t.wide, "c_custkey", scores, sel.any_of("no_such_column")))


@query("p3_column_range", "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def _(t):
    return sel.select(t.lineitem, sel.between("l_quantity", "l_tax"))


@query("p3_drop_column_range", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return sel.drop(t.lineitem, sel.between("l_quantity", "l_tax"), "l_shipdate")


@query("p4_columns_to_front", "SELECT o_orderpriority, o_orderstatus, o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    return sel.to_front(t.orders.drop("o_orderdate"), "o_orderpriority", sel.matches("status$"))


@query("p5_drop_columns", "SELECT p_partkey, p_brand, p_type, p_size FROM part")
def _(t):
    return t.part.drop("p_name", "p_retailprice")


@query("p6_rename_by_function", """
    SELECT s_suppkey, s_name AS NAME_t2, s_nationkey AS NATIONKEY_t2, s_acctbal AS ACCTBAL_t2 FROM supplier""")
def _(t):
    upper = sel.rename_with(t.supplier, lambda c: c.removeprefix("s_").upper(), ~sel.any_of("s_suppkey"))
    return sel.add_suffix(upper, "_t2", keep=["s_suppkey"])


@query("p7_columns_sorted", "SELECT c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey FROM customer")
def _(t):
    return sel.sort_columns(t.customer)


@query("p8_across", """
    SELECT l_orderkey, l_linenumber, l_partkey, i1 - 1 AS i1, i2 - 1 AS i2, i3 - 1 AS i3, i4 - 1 AS i4, i5 - 1 AS i5,
           (i1 - 1) * 2 AS "i1.d", (i5 - 1) * 2 AS "i5.d" FROM items""")
def _(t):
    base = t.items.drop("l_suppkey", "l_quantity", "l_shipdate")
    shifted = sel.across(base, sel.matches(r"^i\d$"), lambda c: c - 1)
    return sel.across(shifted, sel.all_of("i1", "i5"), lambda c: c * 2, "{col}.d")


@query("p9_arithmetic", """
    SELECT l_orderkey, l_linenumber, l_partkey, i1 + i4 + i5 AS total, i2 - i3 AS difference FROM items""")
def _(t):
    return t.items.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("i1") + F.col("i4") + F.col("i5")).alias("total"), (F.col("i2") - F.col("i3")).alias("difference"),
    )


@query("p10_constant_column", "SELECT s_suppkey, 2 AS wave, 'toMatch' AS role FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", F.lit(2).alias("wave"), F.lit("toMatch").alias("role"))


@query("p11_membership_flag", """
    SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS stayed FROM customer""")
def _(t):
    big = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return keys.flag_members(t.customer.select("c_custkey"), big, "c_custkey", "stayed")


@query("p12_key_set", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return t.orders.where("o_orderstatus = 'F'").select("o_custkey").distinct()


# --- filters ---------------------------------------------------------------


@query("f1_text_filter_keeps_missing", """
    SELECT o_orderkey, answer FROM typed WHERE answer IS NULL OR NOT regexp_matches(answer, 'HIGH|none', 'i')""")
def _(t):
    return filters.drop_matching(t.typed, "answer", "high|NONE")


@query("f2_present", "SELECT l_orderkey, l_linenumber, l_partkey, i1 FROM items WHERE i1 IS NOT NULL AND i2 IS NOT NULL")
def _(t):
    return filters.keep_present(t.items, "i1", "i2").select("l_orderkey", "l_linenumber", "l_partkey", "i1")


@query("f3_equality", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    return t.orders.where(F.col("o_orderstatus") == "P").select("o_orderkey", "o_totalprice")


@query("f4_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(t):
    return filters.keep_in(t.customer, "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "c_mktsegment")


@query("f4_not_in_list_keeps_missing", """
    SELECT l_orderkey, l_linenumber, l_partkey, a1 FROM answers WHERE a1 IS NULL OR a1 NOT IN (2, 4)""")
def _(t):
    return filters.drop_in(t.answers, "a1", [2, 4]).select("l_orderkey", "l_linenumber", "l_partkey", "a1")


@query("f5_threshold", "SELECT event_id, value FROM events WHERE value >= 55")
def _(t):
    return t.events.where(F.col("value") >= 55).select("event_id", "value")


@query("f6_listwise_deletion", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM items
    WHERE i1 IS NOT NULL AND i2 IS NOT NULL AND i3 IS NOT NULL AND i4 IS NOT NULL AND i5 IS NOT NULL""")
def _(t):
    return filters.complete_rows(t.items, ["i1", "i2", "i3", "i4", "i5"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("f7_incomplete_rows", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM items
    WHERE i1 IS NULL OR i2 IS NULL OR i3 IS NULL OR i4 IS NULL OR i5 IS NULL""")
def _(t):
    return filters.incomplete_rows(t.items, ["i1", "i2", "i3", "i4", "i5"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("f8_compound_three_valued", """
    SELECT l_orderkey, l_linenumber, l_partkey, (a1 >= 4 OR a2 >= 5) AS any_high, (a1 <= 3 AND a2 <= 3) AS both_low
    FROM answers""")
def _(t):
    a1, a2 = F.col("a1"), F.col("a2")
    return t.answers.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        ((a1 >= 4) | (a2 >= 5)).alias("any_high"), ((a1 <= 3) & (a2 <= 3)).alias("both_low"),
    )


@query("f9_minimum_ties_kept", """
    SELECT p_partkey, p_size FROM part WHERE p_size = (SELECT min(p_size) FROM part)""")
def _(t):
    return groups.at_extreme(t.part.select("p_partkey", "p_size"), "p_size")


@query("f10_not_category", "SELECT l_orderkey, l_linenumber, l_partkey, f1 FROM answers WHERE f1 <> 2")
def _(t):
    return filters.not_category(t.answers, "f1", 2).select("l_orderkey", "l_linenumber", "l_partkey", "f1")


# --- sorting, slicing, set operations --------------------------------------


@query("o1_sort_missing_last", """
    SELECT a1, count(*) AS n FROM answers GROUP BY a1 ORDER BY a1 DESC NULLS LAST""")
def _(t):
    return groups.ordered(groups.group_counts(t.answers, "a1"), {"a1": "desc"})


@query("o1_sort_mixed", """
    SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL
    ORDER BY o_orderpriority, o_orderstatus DESC""")
def _(t):
    counts = groups.group_counts(t.orders, "o_orderpriority", "o_orderstatus")
    return groups.ordered(counts, {"o_orderpriority": "asc", "o_orderstatus": "desc"})


@query("o2_sorted_distinct", "SELECT DISTINCT p_brand FROM part ORDER BY p_brand")
def _(t):
    return t.part.select("p_brand").distinct().orderBy("p_brand")


@query("o3_rows_by_id", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey)""")
def _(t):
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")).select("o_orderkey")
    return t.orders.select("o_orderkey", "o_totalprice").join(last, "o_orderkey", "left_semi")


@query("o4_top_with_ties", """
    SELECT p_brand, p_partkey, p_size FROM part
    QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) = 1""")
def _(t):
    return groups.at_extreme(t.part.select("p_brand", "p_partkey", "p_size"), "p_size", ["p_brand"], largest=True)


@query("o5_level_order", """
    SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1
           WHEN '2-HIGH' THEN 2 WHEN '1-URGENT' THEN 3 END AS ord
    FROM orders GROUP BY o_orderpriority ORDER BY ord""")
def _(t):
    order = ["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    counts = groups.group_counts(t.orders, "o_orderpriority")
    return counts.withColumn("ord", labels.level_order("o_orderpriority", order)).orderBy("ord")


@query("u1_union_by_name", """
    SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
                          F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u2_union_tagged", """
    SELECT 'customer' AS source, n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
    UNION ALL SELECT 'supplier', n_nationkey, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def _(t):
    a = t.customer.select(F.col("c_nationkey").alias("n_nationkey"))
    b = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"))
    both = reshape.union_tagged({"customer": a, "supplier": b}, "source")
    counts = groups.group_counts(both, "source", "n_nationkey")
    return counts.join(t.nation.select("n_nationkey"), "n_nationkey", "left_semi")


@query("u3_set_difference", """
    SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000""")
def _(t):
    big = t.orders.where("o_totalprice > 300000").select("o_custkey")
    return t.customer.select("c_custkey").subtract(big)


@query("u4_set_intersection", """
    SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0""")
def _(t):
    a = t.lineitem.where("l_quantity > 49").select(F.col("l_suppkey").alias("k"))
    return a.intersect(t.supplier.where("s_acctbal > 0").select("s_suppkey"))


@query("u4_keep_members_with_repeats", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def _(t):
    rich = t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return t.lineitem.join(rich, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("u5_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return t.events.select("user_id", "event_type").distinct()


@query("u6_column_bind", """
    SELECT s_suppkey, round((s_acctbal - (SELECT avg(s_acctbal) FROM supplier)) / (SELECT stddev_samp(s_acctbal) FROM supplier), 6) AS z_balance,
           round((s_nationkey - (SELECT avg(s_nationkey) FROM supplier)) / (SELECT stddev_samp(s_nationkey) FROM supplier), 6) AS z_nation
    FROM supplier""")
def _(t):
    z = groups.zscore(t.supplier, ["s_acctbal", "s_nationkey"])
    return z.select("s_suppkey", r("s_acctbal_z").alias("z_balance"), r("s_nationkey_z").alias("z_nation"))


# --- scalar functions ------------------------------------------------------


@query("x1_upper_lower", "SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.upper("c_name").alias("up"), F.lower("c_mktsegment").alias("low"))


@query("x2_regex_replace", r"SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.length(text.strip_spaces("text")).cast("bigint").alias("n"))


@query("x3_literal_find", "SELECT p_partkey, contains(p_name, 'ed w') AS hit FROM part")
def _(t):
    return t.part.select("p_partkey", F.col("p_name").contains("ed w").alias("hit"))


@query("x4_regex_find", "SELECT o_orderkey, coalesce(regexp_matches(answer, '^[1-3]-|X$', 'i'), false) AS hit FROM typed")
def _(t):
    return t.typed.select("o_orderkey", missing.text_match("answer", "^[1-3]-|x$", ignore_case=True).alias("hit"))


@query("x5_zero_pad_ids", """
    SELECT c_custkey, CASE WHEN c_custkey < 1000 THEN 'Z02_HH_' || lpad(CAST(c_custkey AS VARCHAR), 3, '0')
                           ELSE CAST(c_custkey AS VARCHAR) END AS ref FROM customer""")
def _(t):
    return t.customer.select("c_custkey", text.pad_id(F.col("c_custkey").cast("string"), "Z02_HH_").alias("ref"))


@query("x6_paste_missing_as_text", """
    SELECT o_orderkey, coalesce(answer, 'NA') || ' ' || o_orderkey || ' ' || coalesce(answer, 'NA') AS word FROM typed""")
def _(t):
    return t.typed.select("o_orderkey", missing.paste(["answer", "o_orderkey", "answer"]).alias("word"))


@query("x7_split_parts", """
    SELECT p_partkey, string_split_regex(p_name || '-' || p_brand, '[^\\p{L}\\p{N}]+')[1] AS w1,
           string_split_regex(p_name || '-' || p_brand, '[^\\p{L}\\p{N}]+')[4] AS w4,
           string_split_regex(p_name || '-' || p_brand, '[^\\p{L}\\p{N}]+')[5] AS w5 FROM part""".replace("\\\\", "\\"))
def _(t):
    joined = F.concat_ws("-", "p_name", "p_brand")
    first, _b, _c, fourth, fifth = text.split_parts(joined, ["w1", "w2", "w3", "w4", "w5"])
    return t.part.select("p_partkey", first, fourth, fifth)


@query("x8_missing_default", "SELECT o_orderkey, coalesce(upper(answer), 'XX') AS initials FROM typed")
def _(t):
    return t.typed.select("o_orderkey", text.initials("answer").alias("initials"))


@query("x9_value_to_missing", "SELECT o_orderkey, nullif(answer, 'none') AS answer FROM typed")
def _(t):
    return t.typed.select("o_orderkey", F.nullif("answer", F.lit("none")).alias("answer"))


@query("x9_code_word_key", """
    SELECT o_orderkey, coalesce(nullif(upper(trim(replace(answer, '10X', ''))), ''),
                       nullif(upper(coalesce(upper(answer), 'XX') || ' ' || 'XX' || ' ' || 'NA'), 'XX XX NA')) AS ref FROM typed""")
def _(t):
    word = text.code_word("answer", F.lit(None).cast("string"), F.lit(None).cast("string"))
    return t.typed.select("o_orderkey", text.clean_key("answer", word, drop_literal="10X").alias("ref"))


@query("x10_if_else_missing", """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a1 = 2 THEN 'female' WHEN a1 <> 2 THEN 'male' END AS sex FROM answers""")
def _(t):
    return t.answers.select("l_orderkey", "l_linenumber", "l_partkey",
                            missing.if_else(F.col("a1") == 2, "female", "male").alias("sex"))


@query("x11_case_chain", """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN a1 = 1 THEN 'never' WHEN a1 = 2 THEN 'few days' WHEN a1 > 3 THEN 'daily' END AS media FROM answers""")
def _(t):
    a = F.col("a1")
    rules = [(a == 1, "never"), (a == 2, "few days"), (a > 3, "daily")]
    return t.answers.select("l_orderkey", "l_linenumber", "l_partkey", labels.first_true(rules).alias("media"))


@query("x12_value_map", """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE a1 WHEN 5 THEN 1 WHEN 4 THEN 2 WHEN 3 THEN 3 WHEN 2 THEN 4 WHEN 1 THEN 5 END AS a1
    FROM answers""")
def _(t):
    return t.answers.select("l_orderkey", "l_linenumber", "l_partkey",
                            labels.label("a1", {5: 1, 4: 2, 3: 3, 2: 4, 1: 5}).alias("a1"))


@query("x13_parse_date", """
    SELECT event_id, CAST(try_strptime(lpad(CAST(event_id % 40 AS VARCHAR), 2, '0') || '.' || '02.2020', '%d.%m.%Y') AS VARCHAR)[1:10] AS d
    FROM events""")
def _(t):
    typed = F.concat(F.lpad((F.col("event_id") % 40).cast("string"), 2, "0"), F.lit(".02.2020"))
    return t.events.select("event_id", dates.parse_date(typed).cast("string").alias("d"))


@query("x14_days_between", """
    SELECT l_orderkey, l_linenumber, l_partkey, round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400e6, 6) AS days
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    dated = lines.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return dated.select("l_orderkey", "l_linenumber", "l_partkey", r(dates.days_between("l_shipdate", "o_orderdate")).alias("days"))


@query("x15_age_years", """
    SELECT o_orderkey, CAST(round_even((epoch_us(TIMESTAMP '2021-10-19') - epoch_us(o_orderdate)) / 86400e6 / 365.25, 0) AS INT) AS years,
           20 + CAST(round_even((epoch_us(TIMESTAMP '2021-10-19') - epoch_us(o_orderdate)) / 86400e6 / 365.25, 0) AS INT) AS age2 FROM orders""")
def _(t):
    end = F.lit("2021-10-19").cast("timestamp")
    return t.orders.select("o_orderkey", dates.years_between(end, "o_orderdate").alias("years"),
                           dates.age_later(F.lit(20), end, "o_orderdate").alias("age2"))


@query("x16_semesters", """
    SELECT o_orderkey, CAST(floor((epoch_us(TIMESTAMP '2021-10-19') - epoch_us(o_orderdate)) / 86400e6 / 365 * 2) AS INT) AS semesters FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", dates.semesters_between(F.lit("2021-10-19").cast("timestamp"), "o_orderdate").alias("semesters"))


@query("x17_rounding", """
    SELECT event_id, CAST(floor(value) AS BIGINT) AS fl, round_even(value * 2, 0) / 2 AS half, abs(value - 20) AS gap,
           CASE WHEN value = 0 THEN 0 ELSE round_even(value * pow(10, 3 - ceil(log10(abs(value)))), 0) / pow(10, 3 - ceil(log10(abs(value)))) END AS s3
    FROM events""")
def _(t):
    v = F.col("value")
    return t.events.select(
        "event_id", F.floor(v).alias("fl"), (numeric.round_half_even(v * 2) / 2).alias("half"),
        F.abs(v - 20).alias("gap"), numeric.signif(v, 3).alias("s3"),
    )


@query("x18_casts", """
    SELECT o_orderkey, try_cast(answer AS INTEGER) AS n, try_cast(substr(answer, 1, 1) AS DOUBLE) AS d FROM typed""")
def _(t):
    a = F.col("answer")
    return t.typed.select("o_orderkey", a.try_cast("int").alias("n"), F.substring(a, 1, 1).try_cast("double").alias("d"))


@query("x19_null_test", "SELECT l_orderkey, l_linenumber, l_partkey, i1 IS NULL AS gone FROM items")
def _(t):
    return t.items.select("l_orderkey", "l_linenumber", "l_partkey", F.col("i1").isNull().alias("gone"))


@query("x21_flatten_array", """
    SELECT user_id, string_agg(event_type, '+' ORDER BY event_type) AS kinds
    FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id""")
def _(t):
    return t.events.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), "+").alias("kinds"))


@query("x22_sequence", """
    SELECT s_suppkey, CAST(c AS INT) AS caliper FROM supplier, (SELECT unnest(range(25, 101, 5)) AS c)""")
def _(t):
    return t.supplier.select("s_suppkey", F.explode(numeric.hundredths(25, 100, 5)).alias("caliper"))


@query("x23_significance_marks", """
    SELECT event_id, CASE WHEN p < .001 THEN '***' WHEN p < .01 THEN '**' WHEN p < .05 THEN '*' WHEN p < .1 THEN '#' WHEN p < .2 THEN '##' ELSE '' END AS graded,
           CASE WHEN p < .001 THEN '***' WHEN p < .01 THEN '**' WHEN p < .05 THEN '*' ELSE '' END AS plain
    FROM (SELECT event_id, value / 100 AS p FROM events)""")
def _(t):
    p = F.col("value") / 100
    return t.events.select("event_id", labels.stars(p, labels.GRADED_STARS).alias("graded"), labels.stars(p).alias("plain"))


@query("x24_report_string", """
    SELECT event_type, printf('r(%.0f) = %.2f [%.2f; %.2f]', CAST(count(*) AS DOUBLE), avg(value) / 100, min(value) / 100, max(value) / 100)
           || ', ' || 'p < .001' AS report FROM events GROUP BY event_type""")
def _(t):
    x = F.col("value") / 100
    parts = t.events.groupBy("event_type").agg(
        F.count(F.lit(1)).cast("double").alias("df"), F.avg(x).alias("r"), F.min(x).alias("lo"), F.max(x).alias("hi")
    ).withColumn("p", F.lit(0.0))
    return parts.select("event_type", labels.report_r("r", "df", "p", "lo", "hi").alias("report"))
