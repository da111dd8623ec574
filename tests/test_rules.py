"""Missing-value rules and small decisions on literal tables."""

import datetime as dt

from pyspark.sql import functions as F

from panelkit.functions import dates, labels, missing, numeric, scoring, text
from panelkit.operators import filters, groups, joins, keys, reshape


def values(df, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()]


def test_missing_text_is_no_match(spark):
    df = spark.createDataFrame([("test1",), (None,), ("ok",)], "x string")
    assert values(filters.drop_matching(df, "x", "TEST"), "x") == [None, "ok"]


def test_missing_is_never_a_member(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert values(filters.drop_in(df, "x", [3]), "x") == [1, None]


def test_unknown_condition_stays_unknown(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "x int")
    assert values(df, missing.if_else(F.col("x") == 2, "a", "b")) == [None, "b", "a"]
    assert values(df, labels.first_true([(F.col("x") == 2, "a")], "b")) == ["b", "b", "a"]


def test_strict_and_partial_rows(spark):
    df = spark.createDataFrame([(1, 2, None), (1, 2, 3), (None, None, None)], "a int, b int, c int")
    cols = ["a", "b", "c"]
    assert values(df, missing.strict_max(cols)) == [None, 3, None]
    assert values(df, missing.strict_mean(cols)) == [None, 2.0, None]
    assert values(df, missing.present_mean(cols)) == [1.5, 2.0, None]
    assert values(df, scoring.prorated_sum(cols)) == [4.5, 6.0, None]


def test_missing_limit_is_strict(spark):
    rows = [(1, 1, 1, 1, 1), (1, 1, 1, 1, None), (1, 1, 1, None, None)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int")
    assert values(df, scoring.prorated_sum(list("abcde"), 0.2)) == [5.0, 5.0, None]


def test_paste_spells_out_missing(spark):
    df = spark.createDataFrame([("AB", None, dt.date(2020, 1, 2))], "a string, b string, c date")
    assert values(df, missing.paste(["a", "b", "c"])) == ["AB NA 2020-01-02"]
    assert values(df, text.code_word("b", "b", F.lit(None).cast("string"))) == [None]


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-2.5,)], "x double")
    assert values(df, numeric.round_half_even("x")) == [0.0, 2.0, 2.0, -2.0]


def test_significant_digits(spark):
    df = spark.createDataFrame([(0.0,), (1234.5,), (0.0012344,), (-9.996,)], "x double")
    assert values(df, numeric.signif("x", 3)) == [0.0, 1230.0, 0.00123, -10.0]


def test_sort_missing_last(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "x int")
    assert values(groups.ordered(df, {"x": "asc"}), "x") == [1, 2, None]
    assert values(groups.ordered(df, {"x": "desc"}), "x") == [2, 1, None]


def test_single_value_has_no_spread(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, x double")
    assert values(df.groupBy("g").agg(groups.std_error("x").alias("se")), "se") == [None]
    assert values(groups.zscore(df, ["x"]), "x_z") == [None]


def test_first_and_duplicate_keys(spark):
    rows = [("a", 2), ("a", 1), ("a", 3), ("b", 9), (None, 5), (None, 4)]
    df = spark.createDataFrame(rows, "k string, seq int")
    first = keys.first_per_key(df, ["k"], ["seq"])
    assert sorted(values(first, "k", "seq"), key=str) == [("a", 1), ("b", 9), (None, 4)]
    assert set(values(keys.duplicated_keys(df, "k"), "k")) == {"a", None}


def test_running_number_same_when_spread(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), ((F.col("id") * 37) % 501).alias("o"))
    plain = keys.running_number(df, ["g"], ["o"]).collect()
    spread = keys.running_number(df, ["g"], ["o"], window_rows=5).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, spread))


def test_free_text(spark):
    rows = ["", "0", "0x", "10x", "+", "+-", "*", "x", "-", None, "abc"]
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    assert values(df, text.event_code("x")) == [0, 0, 0, 2, 1, 2, 1, 2, 3, 2, 2]


def test_pads_and_dates(spark):
    df = spark.createDataFrame([("7",), ("42",), ("123",), ("Z02_HH_001",)], "x string")
    assert values(df, text.pad_id("x", "Z02_HH_")) == ["Z02_HH_007", "Z02_HH_042", "Z02_HH_123", "Z02_HH_001"]
    df = spark.createDataFrame([("31.02.2020",), ("01.05.2020",), ("",)], "x string")
    assert values(df, dates.parse_date("x")) == [None, dt.date(2020, 5, 1), None]


def test_clean_key(spark):
    df = spark.createDataFrame(
        [("Z02-1 ", "w"), ("http://x", "w"), (None, "w"), ("z0w7", "w")], "ref string, word string"
    )
    key = text.clean_key("ref", F.col("word"), "http://x", [("Z02-", "Z02_"), ("z0w", "Z02W")])
    assert values(df, key) == ["Z02_1", "w", "w", "Z02W7"]


def test_severity_stops_at_missing(spark):
    df = spark.createDataFrame([(2, 1), (1, 2), (2, None), (1, 1), (None, 1)], "mild int, bad int")
    assert values(df, labels.severest(["mild", "bad"])) == [1, 2, None, 0, None]


def test_one_hot_with_missing(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, c string")
    out = reshape.one_hot(df, "c")
    assert out.columns == ["id", "c_a", "c_b", "c_NA"]
    assert sorted(map(tuple, out.collect())) == [(1, 1, 0, 0), (2, 0, 1, 0), (3, 0, 0, 1)]


def test_pivot_fills_absent_cells_only(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 2, None), (2, 0, 7.0)], "id int, w int, x double")
    out = reshape.to_wide(df, ["id"], "w", "x", [0, 2], "w", fill=0.0)
    assert sorted(map(tuple, out.collect())) == [(1, 5.0, None), (2, 7.0, 0.0)]


def test_long_and_back(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 7.0, 1.0)], "id int, a double, b double")
    long = reshape.to_long(df, ["id"], ["a", "b"])
    assert long.count() == 4
    back = reshape.to_wide(long, ["id"], "variable", "value", ["a", "b"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_median_split_ties_low(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (None,)], "x double")
    assert values(groups.median_split(df, "x"), "x_group") == ["low", "low", "low", "high", None]


def test_suffix_join_and_changes(spark):
    long = spark.createDataFrame([("s", 0, 1.0), ("s", 2, 4.0), ("u", 0, 9.0)], "k string, w int, x double")
    wide = joins.add_changes(joins.wave_frame(long, "k", "w", [0, 2], ["x"]), ["x"], 2, 0)
    assert [r.asDict() for r in wide.collect()] == [{"k": "s", "x_t0": 1.0, "x_t2": 4.0, "x_t2minust0": 3.0}]
    a = spark.createDataFrame([("s", "u", 1)], "k string, match string, v int")
    b = spark.createDataFrame([("u", 2)], "k string, v int")
    joined = joins.join_suffixed(a, b, "match", "k").collect()[0].asDict()
    assert joined == {"k": "s", "match": "u", "v_x": 1, "v_y": 2}
