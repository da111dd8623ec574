"""Mixed rows meet their sources' targets; surrogates of numbers stay apart; long texts take linear time."""

import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelkit.llm import mixing, surrogates
from panelkit.session import load

from .test_operators import words


@pytest.mark.parametrize("shard_tokens", [1_000_000, 2_000])
def test_mixed_rows_meet_the_target_of_each_source(spark, shard_tokens):
    docs = load(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "source")
    want, sizes, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in mixing.mix_sizes(mixing.sized(docs, "doc_id", "text", "source"), shard_tokens=shard_tokens).collect():
        want[r.source] += r.taken
        sizes[r.source] += r["size"]
        most[r.source] = max(most[r.source], r["size"])
    got = defaultdict(int)
    for r in mixing.mixed_rows(docs, shard_tokens=shard_tokens).collect():
        got[r.source] += len(words(r.text))
    for s, n in want.items():
        assert abs(got[s] - n) <= most[s] * max(1, -(-sizes[s] // shard_tokens)), s


def test_small_sources_are_not_lost(spark):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate(
        [(1000, "a"), (1014, "b"), (50, "c"), (60, "c"), (70, "c"), (80, "c")])] + [(None, None, "d"), (None, "", None)], "doc_id long, text string, source string")
    got = defaultdict(int)
    for r in mixing.mixed_rows(docs).collect():
        got[r.source] += len(r.text.split())
    targets = {r.source: r.target for r in mixing.mix_sizes(mixing.sized(docs, "doc_id", "text", "source")).collect()}
    assert set(got) == {"a", "b", "c"}
    for s, most in {"a": 1000, "b": 1014, "c": 80}.items():
        assert abs(got[s] - targets[s]) <= most + 16
    assert mixing.mixed_rows(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", [":" * 1_000_000 + "g", "key=" * 250_000, "::" + "a:" * 400_000 + "g", "key=a@" * 150_000])
def test_time_is_linear(text):
    begun = time.time()
    list(surrogates.mentions(text))
    assert time.time() - begun < 2


def test_numbers_of_all_kinds_stay_apart(spark):
    rows = [("phone", "49:493012345"), ("phone", "49:498765432"), ("number", "493000000"), ("number:valid", "4111111111111111"),
            ("number", "5500000000000004"), ("phone", "1:15550000000"), ("mail", "a@b.org")]
    found = spark.createDataFrame(rows, "kind string, entity string")

    # First draws: a real phone, a real number, one number for two kinds; then each its own.
    first = F.create_map(*[F.lit(x) for x in ("49:493012345", "498765432", "49:498765432", "493000000", "493000000", "777",
                                              "4111111111111111", "777", "5500000000000004", "5500000000000004")])
    draw = lambda w: w.withColumn("new", F.when(F.col("attempt") == 0, F.coalesce(first[F.col("entity")], F.concat(F.lit("n"), "entity")))
                                  .otherwise(F.concat(F.lit("later"), "entity")))
    late = {(r.kind, r.entity): r.attempt for r in surrogates.settled(found, draw).collect()}
    assert late == {("phone", "49:493012345"): 1, ("phone", "49:498765432"): 1, ("number:valid", "4111111111111111"): 1,
                    ("number", "5500000000000004"): 1} or late == {
                    ("phone", "49:493012345"): 1, ("phone", "49:498765432"): 1, ("number", "493000000"): 1, ("number", "5500000000000004"): 1}


def test_corpus_surrogates_are_distinct(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    found = surrogates.entities(docs)
    late = {(r.kind, r.entity): r.attempt for r in surrogates.later_attempts(found, b"k").collect()}
    families, real = defaultdict(list), defaultdict(set)
    for kind, entity in found.collect():
        family = "digits" if kind in ("phone", "number", "number:valid") else kind
        families[family].append(surrogates.surrogate(b"k", kind, entity, late.get((kind, entity), 0)))
        real[family].add(entity.split(":")[-1] if kind == "phone" else entity)
    assert families
    for family, new in families.items():
        assert len(set(new)) == len(new) and not set(new) & real[family]


def test_accounts_keep_valid_check_digits():
    new = surrogates.surrogate(b"k", "account", "DE89370400440532013000")
    assert new[:2] == "DE" and new != "DE89370400440532013000" and surrogates.remainder(new) == 1
    assert surrogates.remainder("DE89370400440532013000") == 1 and surrogates.remainder("DE88370400440532013000") != 1


@pytest.mark.parametrize("text, left", [("Mr. O'Brien's dog", "Brien"), ("Mrs. Anna O’Neill met", "Neill"), ("Dr. Smith's list", "Smith")])
def test_names_with_apostrophes(text, left):
    new, kinds = surrogates.replaced(text, b"k", lambda kind, entity: 0)
    assert left not in new and new[-4:] == text[-4:] and (("'s " in text) == ("'s " in new))
