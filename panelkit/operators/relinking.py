"""Fuzzy candidates kept up to date while reviewers decide.

Counts of old rows per combination of parts are never rebuilt. Decisions that drop or
correct old rows become signed deltas on those counts; only new codes that share a touched
combination, of a size that can matter to them, are looked up again.

A combination holds the number of its old rows and the exclusive or of their numbers. Both
take a row out as easily as in, and where one row is left the second is its number, so a
single candidate is known without a list of the others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, fits, shuffled
from .linkage import _combination_rows, accepted_decisions, invalid_duplicates


@dataclass(frozen=True)
class Links:
    """Open new codes (``new`` and parts), old rows (``no``, ``old`` and parts), counts (``combo``,
    ``n``, ``who``; first the base, then deltas) and the best candidates of each open code."""

    parts: tuple[str, ...]
    new: DataFrame
    old: DataFrame
    counts: tuple[DataFrame, ...]
    best: DataFrame

    def candidates(self) -> DataFrame:
        """new, concordance, n_candidates and old, where there is one candidate."""
        single = self.best.where("n_candidates = 1").select("new", F.col("who").alias("no")).join(shuffled(self.old.select("no", "old")), "no")
        return self.best.drop("who").join(shuffled(single.select("new", "old")), "new", "left")


def _sizes(parts: Sequence[str]) -> range:
    return range(len(parts), 0, -1)


def _best(new: DataFrame, counts: Sequence[DataFrame], parts: Sequence[str]) -> DataFrame:
    """Best concordance of the given codes; only combinations they have are summed up."""
    wanted = _combination_rows(new, ["new"], parts, _sizes(parts)).select("new", "k", "combo")
    named = wanted.select("combo").distinct()
    every = counts[0]
    for delta in counts[1:]:
        every = every.unionByName(delta)
    here = every.join(shuffled(named), "combo", "left_semi").groupBy("combo").agg(F.sum("n").alias("n"), F.bit_xor("who").alias("who")).where("n > 0")
    # Old rows that agree on no more than k parts share one combination of k with the code each.
    sized = wanted.join(shuffled(here), "combo").groupBy("new", "k").agg(F.sum("n").alias("n"), F.bit_xor("who").alias("who"))
    top = sized.groupBy("new").agg(F.max(F.struct("k", "n", "who")).alias("b"))
    return new.select("new").join(shuffled(top), "new", "left").select(
        "new", F.coalesce("b.k", F.lit(0)).alias("concordance"), F.coalesce("b.n", F.lit(0)).cast("bigint").alias("n_candidates"), F.col("b.who").alias("who"))


def start(new: DataFrame, old: DataFrame, key: str, row_id: str, parts: Sequence[str]) -> Links:
    """Candidates of all new codes. ``row_id`` numbers the old rows, each its own number."""
    text = [F.col(p).cast("string").alias(p) for p in parts]
    left = cut(new.select(F.col(key).alias("new"), *text).dropDuplicates(["new"]))
    right = cut(old.select(F.col(row_id).cast("bigint").alias("no"), F.col(key).alias("old"), *text))
    counts = cut(_combination_rows(right, ["no"], parts, _sizes(parts)).groupBy("combo").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("no").alias("who")))
    return Links(tuple(parts), left, right, (counts,), cut(_best(left, [counts], parts)))


def touched_codes(links: Links, delta: DataFrame) -> DataFrame:
    """Open codes with a changed combination of at least their present concordance."""
    changed = F.broadcast(delta.select("combo")) if fits(delta) else shuffled(delta.select("combo"))
    rows = _combination_rows(links.new, ["new"], links.parts, _sizes(links.parts)).select("new", "k", "combo")
    return rows.join(changed, "combo", "left_semi").join(shuffled(links.best.select("new", "concordance")), "new").where(
        F.col("k") >= F.col("concordance")).select("new").distinct()


def after(links: Links, settled: DataFrame | None = None, dropped: DataFrame | None = None, corrected: DataFrame | None = None) -> Links:
    """Links once new codes are ``settled`` (``new``), old rows ``dropped`` (``no``) and others
    ``corrected`` (``no``, ``old`` and parts as they are now). A row that is dropped and
    corrected is dropped; numbers that are no old row are passed over."""
    parts, old = links.parts, links.old
    leave = old.select("no").limit(0)
    for part in (dropped, corrected):
        if part is not None:
            leave = leave.unionByName(part.select(F.col("no").cast("bigint").alias("no")))
    leaving = cut(old.join(shuffled(leave.distinct()), "no", "left_semi"))
    entering = leaving.limit(0)
    if corrected is not None:
        texts = [F.col(p).cast("string").alias(p) for p in parts]
        entering = corrected.select(F.col("no").cast("bigint").alias("no"), "old", *texts).join(shuffled(leaving.select("no")), "no", "left_semi")
        if dropped is not None:
            entering = entering.join(shuffled(dropped.select(F.col("no").cast("bigint").alias("no"))), "no", "left_anti")
        entering = cut(entering)
    signed = leaving.withColumn("sign", F.lit(-1)).unionByName(entering.withColumn("sign", F.lit(1)))
    delta = cut(_combination_rows(signed, ["no", "sign"], parts, _sizes(parts)).groupBy("combo").agg(
        F.sum("sign").alias("n"), F.bit_xor("no").alias("who")).where("n <> 0 OR who <> 0"))
    new, best = links.new, links.best
    if settled is not None:
        gone = settled.select("new").distinct()
        new, best = cut(new.join(shuffled(gone), "new", "left_anti")), best.join(shuffled(gone), "new", "left_anti")
    counts = (*links.counts, delta)
    now = replace(links, new=new, best=best)
    touched = cut(touched_codes(now, delta))
    again = _best(new.join(shuffled(touched), "new", "left_semi"), counts, parts)
    best = cut(best.join(shuffled(touched), "new", "left_anti").unionByName(again))
    rest = cut(old.join(shuffled(leaving.select("no")), "no", "left_anti").unionByName(entering))
    return Links(parts, new, rest, counts, best)


def after_review(links: Links, decisions: DataFrame, corrected: DataFrame | None = None) -> Links:
    """Links once a sheet of decisions is applied: accepted codes are settled, and the invalid
    one of two doubled old records is dropped."""
    bad = invalid_duplicates(decisions).select(F.col("invalid").cast("bigint").alias("no")).where("no IS NOT NULL")
    return after(links, accepted_decisions(decisions).select("new"), bad, corrected)
