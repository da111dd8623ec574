"""Review lists without pairs, and links kept up to date, against forming every pair."""

import random

import pytest
from pyspark.sql import functions as F

from panelkit.operators import linkage, relinking
from panelkit.session import cut

PARTS = ["a", "b", "yyyy", "mm", "dd"]
SCHEMA = "no long, code string, " + ", ".join(f"{p} string" for p in PARTS)


def people(tag, n, rng, first=0):
    def part():
        return rng.choice([None, "hot", "hot", "hot", *"123456"])

    return [(first + i, f"{tag}{i}", *[part() for _ in PARTS]) for i in range(n)]


def brute(new, old):
    """new -> (best concordance, its candidates in order of agreeing parts, then code)."""
    out = {}
    for _, code, *own in new:
        found = []
        for _, other, *parts in old:
            m = sum((x is not None and x == y) << i for i, (x, y) in enumerate(zip(own, parts, strict=True)))
            found.append((m.bit_count(), m, other))
        top = max((k for k, *_ in found), default=0)
        out[code] = (top, [o for k, m, o in sorted(found) if k == top] if top else [])
    return out


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(3)
    new, old = people("n", 70, rng), people("o", 300, rng, 1000)
    new.append((70, "nothing", *[None] * 5))
    return new, old, spark.createDataFrame(new, SCHEMA), spark.createDataFrame(old, SCHEMA)


def test_pages_of_review_lists(sides):
    new, old, left, right = sides
    want = brute(new, old)
    best = cut(linkage.best_candidates(left, right, "code", PARTS))
    lists, members = linkage.review_lists(left, right, "code", PARTS, best)
    pairs = {(r.new, r.old) for r in linkage.expand(lists, members).collect()}
    assert pairs == {(n, o) for n, (_, found) in want.items() for o in found}
    asked = best.select("new", F.explode(F.array(*[F.lit(k) for k in (1, 2, 7, 50, 10_000)])).alias("nth"))
    got = {(r.new, r.nth): r.old for r in linkage.candidates_at(lists, members, asked).collect()}
    assert got == {(n, k): found[k - 1] for n, (_, found) in want.items() for k in (1, 2, 7, 50, 10_000) if k <= len(found)}


def test_review_lists_grow_with_the_codes(spark):
    rows = []
    for times in (1, 4):
        # All codes share one value and nothing else, so every pair is a candidate.
        left, right = (spark.createDataFrame([(i, f"{tag}{i}", "hot", f"{tag}{i}", None, None, None) for i in range(100 * times)], SCHEMA) for tag in "no")
        best = cut(linkage.best_candidates(left, right, "code", PARTS))
        lists, members = linkage.review_lists(left, right, "code", PARTS, best)
        rows.append((lists.count() + members.count(), linkage.expand(lists, members).count()))
    (few, pairs), (many, more) = rows
    assert (few, many, pairs, more) == (200, 800, 10_000, 160_000)


def test_links_after_rounds_of_decisions(spark, sides):
    new, old, left, right = sides
    rng = random.Random(5)
    links = relinking.start(left, right, "code", "no", PARTS)
    for k in range(3):
        want = brute(new, old)
        got = {r.new: (r.concordance, r.n_candidates, r.old) for r in links.candidates().collect()}
        assert got == {n: (top, len(f), f[0] if len(f) == 1 else None) for n, (top, f) in want.items()}
        settled = {r[1] for r in rng.sample(new, 10)}
        dropped = {r[0] for r in rng.sample(old, 25)} | {99_999}
        fixed = [(no, code, *people("x", 1, rng)[0][2:]) for no, code, *_ in rng.sample(old, 20)] + [(77_777, "no such row", *[None] * 5)]
        links = relinking.after(
            links, spark.createDataFrame([(s,) for s in settled], "new string"), spark.createDataFrame([(d,) for d in dropped], "no long"),
            spark.createDataFrame(fixed, SCHEMA).withColumnRenamed("code", "old"))
        changed = {r[0]: r for r in fixed}
        new = [r for r in new if r[1] not in settled]
        old = [changed.get(r[0], r) for r in old if r[0] not in dropped]
    want = brute(new, old)
    got = {r.new: (r.concordance, r.n_candidates, r.old) for r in links.candidates().collect()}
    assert got == {n: (top, len(f), f[0] if len(f) == 1 else None) for n, (top, f) in want.items()}


def test_only_touched_codes_are_looked_up(spark, sides):
    _, old, left, right = sides
    links = relinking.start(left, right, "code", "no", PARTS)
    one = next(r for r in old if "hot" not in r and None not in r[2:])
    delta = linkage._combination_rows(links.old.where(F.col("no") == one[0]), ["no"], PARTS, range(1, 6)).select("combo")
    touched = {r.new for r in relinking.touched_codes(links, delta).collect()}
    assert len(touched) < 20
    after = relinking.after(links, dropped=spark.createDataFrame([(one[0],)], "no long"))
    before = {r.new: tuple(r) for r in links.best.collect()}
    assert all(before[r.new] == tuple(r) for r in after.best.collect() if r.new not in touched)
    same = relinking.after(after)
    assert {tuple(r) for r in same.best.collect()} == {tuple(r) for r in after.best.collect()}
