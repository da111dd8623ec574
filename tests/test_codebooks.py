"""Dictionaries of many columns and many levels."""

import pytest

from panelkit.operators import reshape
from panelkit.sources import readers

N = 150


def frames(spark):
    names = [f"q{i}" for i in range(N)]
    rows = [tuple(None if (r + i) % 11 == 0 else (r * i) % 7 for i in range(N)) for r in range(40)]
    book = [(f"q{i}", str(code), f"label {i} {code}") for i in range(N) for code in range(6)] + [("other", "1", "x")]
    return names, rows, spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)), spark.createDataFrame(book, "variable string, code string, label string")


def expected(rows):
    return [tuple(None if v is None or v == 6 else f"label {i} {v}" for i, v in enumerate(row)) for row in rows]


def test_150_columns_without_a_join(spark):
    names, rows, df, book = frames(spark)
    out, seen = readers.decode_columns(df, book, names)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert [tuple(r) for r in out.collect()] == expected(rows)
    assert seen.get == {f"q{i}": sum(row[i] == 6 for row in rows) for i in range(N)}


def test_joined_columns_give_the_same(spark, monkeypatch):
    names, rows, df, book = frames(spark)
    monkeypatch.setattr(readers, "CODES_SEARCHED", 5)
    some = names[:5]
    out, seen = readers.decode_columns(df.select(*some), book, some)
    assert "Join" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(out.collect(), key=str) == sorted((tuple(r[:5]) for r in expected(rows)), key=str)
    assert seen.get == {c: sum(row[i] == 6 for row in rows) for i, c in enumerate(some)}


def test_codes_listed_twice_and_columns_without_codes(spark):
    df = spark.createDataFrame([(1, "a"), (None, None)], "v int, w string")
    book = spark.createDataFrame([("v", "1", "one")], "variable string, code string, label string")
    out, seen = readers.decode_columns(df, book, ["v", "w"])
    assert [tuple(r) for r in out.collect()] == [("one", None), (None, None)] and seen.get == {"v": 0, "w": 1}
    with pytest.raises(ValueError, match="listed 2 times"):
        readers.decode_columns(df, book.unionAll(book), ["v"])
    empty, _ = readers.decode_columns(df.limit(0), book, ["v", "w"])
    assert empty.count() == 0 and empty.columns == ["v", "w"]


@pytest.mark.parametrize("window_rows", [None, 0])
def test_200_000_levels_stay_in_spark(spark, monkeypatch, window_rows):
    if window_rows is not None:
        own = reshape.running_number
        monkeypatch.setattr(reshape, "running_number", lambda *a: own(*a, window_rows=window_rows))
    df = spark.range(0, 400_000, 1, 8).selectExpr("id", "id % 200000 AS v").unionAll(spark.createDataFrame([(-1, None)], "id long, v long"))
    rows, levels = reshape.one_hot_sparse(df, "v", "hot")
    found = rows.selectExpr("count(*) AS n", "count_if(hot.size = 200001) AS sized",
                            "count_if(hot.indices[0] = if(id < 0, 200000, id % 200000)) AS right", "count_if(size(hot.indices) = 1 AND hot.values[0] = 1) AS single").first()
    assert tuple(found) == (400_001,) * 4 and levels.count() == 200_001
    nothing, _ = reshape.one_hot_sparse(df.limit(0), "v")
    assert nothing.count() == 0 and nothing.columns == ["id", "v"]
