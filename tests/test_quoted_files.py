"""Delimited text with line breaks inside quotes, cut into pieces at any byte."""

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from panelkit.sources import quoted

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("share", T.DoubleType())])


def written(rows, path, encoding="utf-8", end="\n", sep=";"):
    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter=sep, lineterminator=end, quoting=csv.QUOTE_MINIMAL)
    writer.writerow(["id", "te\nxt", "share"])
    writer.writerows([(i, t, str(x).replace(".", ",")) for i, t, x in rows])
    path.write_bytes(out.getvalue().encode(encoding))


def texts(n, seed):
    rng = random.Random(seed)
    bits = ["a", "\n", '"', ";", "\t", "größe", "\n\n", '""', ",", " ", "x" * 30, "\r\n", "\\"]
    return [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) + "z", i / 8) for i in range(n)]


@pytest.fixture
def small_pieces(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, "700")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("encoding, end, sep", [("UTF-8", "\n", ";"), ("UTF-8", "\r\n", "\t"), ("UTF-16LE", "\n", "\t")])
def test_round_trip_from_several_pieces(spark, tmp_path, small_pieces, encoding, end, sep):
    want = []
    for k in range(3):
        rows = [(1000 * k + i, t, x) for i, t, x in texts(300, k)]
        want += rows
        written(rows, tmp_path / f"part{k}.csv", encoding.lower(), end, sep)
    lines = quoted._lines(spark, str(tmp_path), encoding)
    assert lines.select("file", "piece").distinct().count() > 30
    rows, bad = quoted.read_quoted(spark, str(tmp_path), SCHEMA, sep, encoding, decimal_comma=True)
    assert sorted(tuple(r) for r in rows.collect()) == want
    assert bad.count() == 0


def test_rejected_and_endless_records(spark, tmp_path, small_pieces):
    good = '1;"a\nb";0,5\n2;plain;1,5\n\n'
    wrong = '3;"too\nmany";1;2\nx;"not a number";1\n4;t;1,2,3\n5;few\n6;;\n'
    (tmp_path / "a.csv").write_text("id;text;share\n" + good + wrong)
    (tmp_path / "b.csv").write_text('id;text;share\n7;ok;1\n8;"never closed\n' + "more\n" * 2000)
    (tmp_path / "c.csv").write_text("")
    rows, bad = quoted.read_quoted(spark, str(tmp_path), SCHEMA, decimal_comma=True, most_bytes=5000)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "a\nb", 0.5), (2, "plain", 1.5), (6, None, None), (7, "ok", 1.0)]
    found = [(r.record, r["size"]) for r in bad.collect()]
    assert {r for r, _ in found} == {'3;"too\nmany";1;2', 'x;"not a number";1', "4;t;1,2,3", "5;few", None}
    assert [s for r, s in found if r is None] == [len('8;"never closed\n') + 5 * 2000 - 1]


def test_plain_pieces_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;text;share\n" + "".join(f'{i};"t{i}";1\n' for i in range(50)))
    rows, bad = quoted.read_quoted(spark, str(tmp_path), SCHEMA)
    assert rows.count() == 50 and bad.count() == 0
    pieces = quoted._pieces(quoted._lines(spark, str(tmp_path), "UTF-8")).collect()
    assert all(p.plain for p in pieces)
