"""Join sides that grow with the input are never broadcast by an estimate of their size."""

import pytest

from panelkit.operators import linkage, relinking
from panelkit.session import cut
from panelkit.sources import readers, writers

PARTS = ["a", "b", "c"]
SCHEMA = "row_id long, code string, a string, b string, c string"


@pytest.fixture
def plans(monkeypatch):
    """The plans of what the operators materialise."""
    seen = []

    def note(df):
        seen.append(plan(df))
        return cut(df)

    for module in (linkage, relinking):
        monkeypatch.setattr(module, "cut", note)
    return seen


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sides(spark, tmp_path_factory):
    # From files, whose size Spark knows.
    out = []
    for first, tag in ((1, "n"), (0, "o")):
        path = str(tmp_path_factory.mktemp("sides") / tag)
        rows = [(i, f"{tag}{i}", f"x{i % 3}", f"y{i % 5}", f"z{i % 7}") for i in range(first, 40, 2)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_counts_of_combinations(sides, plans):
    out = linkage.best_candidates(*sides, "code", PARTS)
    assert out.count() == 20
    joins = [p for p in [*plans, plan(out)] if "Join" in p]
    assert joins and not any("Broadcast" in p for p in joins)


def test_candidate_pairs(sides, plans):
    best = cut(linkage.best_candidates(*sides, "code", PARTS))
    del plans[:]
    pairs = linkage.candidate_pairs(*sides, "code", PARTS, best)
    assert pairs.count() >= 20
    joins = [p for p in [*plans, plan(pairs)] if "Join" in p]
    assert joins and not any("Broadcast" in p for p in joins)


def test_pages(spark, sides):
    best = cut(linkage.best_candidates(*sides, "code", PARTS))
    lists, members = map(cut, linkage.review_lists(*sides, "code", PARTS, best))
    page = linkage.candidates_at(lists, members, best.selectExpr("new", "1 AS nth"))
    assert page.count() == 20
    assert "Broadcast" not in plan(page)


def test_relinking(sides, plans, monkeypatch):
    # As if no delta were small enough to be broadcast after it was measured.
    monkeypatch.setattr(relinking, "fits", lambda df: False)
    new, old = sides
    links = relinking.start(new, old, "code", "row_id", PARTS)
    links = relinking.after(links, settled=new.where("row_id = 1").selectExpr("code AS new"), dropped=old.where("row_id = 4").selectExpr("row_id AS no"))
    out = links.candidates()
    assert out.count() == 19
    joins = [p for p in [*plans, plan(out)] if "Join" in p]
    assert joins and not any("Broadcast" in p for p in joins)


def test_pairs_of_written_lists(spark, sides, tmp_path):
    best = cut(linkage.best_candidates(*sides, "code", PARTS))
    writers.write_review_lists(*linkage.review_lists(*sides, "code", PARTS, best), str(tmp_path / "lists"))
    pairs = linkage.expand(*readers.read_review_lists(spark, str(tmp_path / "lists")))
    assert pairs.count() == linkage.candidate_pairs(*sides, "code", PARTS, best).count()
    assert "Broadcast" not in plan(pairs)
