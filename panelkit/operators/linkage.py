"""Linking subjects whose typed code words differ in some parts.

Concordance of two codes is the number of equal parts; a missing part equals
nothing. For each new code the old codes at the highest concordance are its
candidates.

No pair is formed to find them. If no old code agrees with a new code on more
than k parts, each old code agreeing on exactly k parts agrees on exactly one
set of k. So the candidate count of a code at its best size is the sum, over the
sets of that size, of how many old codes share that combination of values. The
old side is therefore counted per combination first (one row each, however hot
the combination), and the new side looks the counts up. The candidates themselves
stay factorised (:func:`review_lists`): codes to combinations and combinations to
old codes; each pair comes from one combination only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NON_ALNUM
from ..session import cut, shuffled, spread
from .keys import running_number

COMMENT_AUTO = "auto match"


def _combination_rows(
    df: DataFrame, keep: Sequence[str], parts: Sequence[str], sizes: Sequence[int]
) -> DataFrame:
    """One row per set of k parts without a missing part: ``m``, ``k`` and ``combo``,
    the set and its values. A set is a bit mask ``m`` over the parts."""
    masks = [m for m in range(1, 2 ** len(parts)) if m.bit_count() in set(sizes)]
    missing = " + ".join(f"if(`{p}` IS NULL, {1 << i}, 0)" for i, p in enumerate(parts))
    # Lengths keep ("a", "bc") apart from ("ab", "c").
    values = ", ".join(
        f"if(m & {1 << i} = 0, '', concat(length(`{p}`), ':', `{p}`, '|'))" for i, p in enumerate(parts)
    )
    chosen = df.select(*keep, *parts, F.explode(F.expr(f"array({', '.join(map(str, masks))})")).alias("m"))
    return chosen.where(F.expr(f"m & ({missing}) = 0")).select(
        *keep, "m", F.bit_count("m").alias("k"), F.expr(f"concat(m, '/', {values})").alias("combo")
    )


def _as_text(df: DataFrame, key: str, parts: Sequence[str], name: str) -> DataFrame:
    return df.select(F.col(key).alias(name), *[F.col(p).cast("string").alias(p) for p in parts])


def best_candidates(
    new: DataFrame, old: DataFrame, key: str, parts: Sequence[str], min_concordance: int = 1
) -> DataFrame:
    """Best concordance of each new code and how many old codes reach it.

    Columns ``new``, ``concordance``, ``n_candidates``, ``old`` (when there is
    exactly one) and ``comment``. Codes without any candidate have concordance
    0. Sets of more than half the parts are tried first, as their combinations
    are rare; only the codes they leave open see the smaller sets.
    """
    left = cut(spread(_as_text(new, key, parts, "new").dropDuplicates(["new"])))
    right = cut(spread(_as_text(old, key, parts, "old")))
    sizes = range(len(parts), min_concordance - 1, -1)
    large, small = [k for k in sizes if 2 * k > len(parts)], [k for k in sizes if 2 * k <= len(parts)]
    found: list[DataFrame] = []
    for group in (g for g in (large, small) if g):
        counts = _combination_rows(right, ["old"], parts, group).groupBy("combo").agg(
            F.count(F.lit(1)).alias("n"), F.min("old").alias("old")
        )
        per_size = [
            F.struct(
                F.lit(k).alias("k"),
                F.sum(F.when(F.col("k") == k, F.col("n"))).alias("n"),
                F.min(F.when(F.col("k") == k, F.col("old"))).alias("old"),
            )
            for k in group
        ]
        hits = _combination_rows(left, ["new"], parts, group).join(shuffled(counts), "combo")
        best = cut(
            hits.groupBy("new")
            .agg(F.filter(F.array(*per_size), lambda s: s.getField("n").isNotNull())[0].alias("b"))
            .select("new", F.col("b.k").alias("concordance"), F.col("b.n").alias("n_candidates"),
                    F.col("b.old").alias("old"))
        )
        found.append(best)
        left = left.join(shuffled(best), "new", "left_anti")
    out = left.select(
        "new", F.lit(0).alias("concordance"), F.lit(0).cast("bigint").alias("n_candidates"),
        F.lit(None).cast("string").alias("old"),
    )
    for part in found:
        out = out.unionByName(part)
    return accept_single(out.withColumn("old", F.col("old").cast(right.schema["old"].dataType)))


def accept_single(best: DataFrame) -> DataFrame:
    """Accept a code that has exactly one best candidate."""
    single = F.col("n_candidates") == 1
    return best.select(
        "new", "concordance", "n_candidates",
        F.when(single, F.col("old")).alias("old"),
        F.when(single, COMMENT_AUTO).otherwise("").alias("comment"),
    )


def review_lists(
    new: DataFrame, old: DataFrame, key: str, parts: Sequence[str], best: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The candidates of every new code at its best concordance, without listing pairs.

    ``lists`` has a row per new code and combination: ``new``, ``concordance``, ``combo``,
    how many old codes share it (``n``) and how many candidates of the code come before them
    (``before``). ``members`` has a row per old code and combination that some list names:
    ``combo``, ``old`` and its ``place``, from 1. Both grow with the codes, at most by the
    number of sets of parts; a combination shared by a third of all codes is stored once.
    Candidates are in order of the parts that agree (the set as a number), then of ``old``.
    """
    left = _as_text(new, key, parts, "new").join(shuffled(best.select("new", "concordance")), "new")
    sizes = range(len(parts), 0, -1)
    wanted = _combination_rows(left, ["new", "concordance"], parts, sizes).where(F.col("k") == F.col("concordance")).drop("k")
    shared = _combination_rows(_as_text(old, key, parts, "old"), ["old"], parts, sizes).select("combo", "old")
    named = wanted.select("combo").distinct()
    members = cut(running_number(cut(shared.join(shuffled(named), "combo", "left_semi")), ["combo"], ["old"], "place"))
    counted = wanted.join(shuffled(members.groupBy("combo").agg(F.count(F.lit(1)).alias("n"))), "combo")
    # A code has at most as many rows here as there are sets of one size.
    earlier = Window.partitionBy("new").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    lists = counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return lists.select("new", "concordance", "combo", "n", "before"), members


def expand(lists: DataFrame, members: DataFrame) -> DataFrame:
    """Every (new, old) pair of factorised lists, with its concordance."""
    return lists.select("new", "concordance", "combo").join(shuffled(members.select("combo", "old")), "combo").drop("combo")


def candidates_at(lists: DataFrame, members: DataFrame, asked: DataFrame) -> DataFrame:
    """The ``nth`` candidate (from 1) of each asked ``new``; numbers past the end give no row.
    Each request meets one combination and one member of it."""
    held = asked.select("new", "nth").join(shuffled(lists), "new").where((F.col("nth") > F.col("before")) & (F.col("nth") <= F.col("before") + F.col("n")))
    place = held.select("new", "concordance", "nth", "combo", (F.col("nth") - F.col("before")).alias("place"))
    return place.join(shuffled(members), ["combo", "place"]).select("new", "concordance", "nth", "old")


def candidate_pairs(
    new: DataFrame, old: DataFrame, key: str, parts: Sequence[str], best: DataFrame
) -> DataFrame:
    """Every (new, old) pair at the best concordance found by :func:`best_candidates`; as many
    rows as there are pairs. :func:`review_lists` holds the same in linear space."""
    return expand(*review_lists(new, old, key, parts, best))


def exact_links(new: DataFrame, old: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Keys that occur once among the new and are not repeated among the old,
    split into those found among the old and those not found."""
    once = new.groupBy(key).count().where((F.col("count") == 1) & F.col(key).isNotNull()).select(key)
    counted = old.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    looked = once.join(shuffled(counted), key, "left").where(F.coalesce("_n", F.lit(0)) <= 1)
    return (
        looked.where(F.col("_n").isNotNull()).select(key),
        looked.where(F.col("_n").isNull()).select(key),
    )


# Grades a reviewer gives to a pair that should be used, and the
# word that marks a doubled old record.
ACCEPTED = ("+", "?", "??", "???")
DOUBLED = "doppelt"


def accepted_decisions(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("decision").isin(*ACCEPTED))


def invalid_duplicates(decisions: DataFrame) -> DataFrame:
    """The old record to discard for each pair the reviewer called doubled:
    of the two record numbers in the comment, the one not named as valid."""
    words = F.split("comment", NON_ALNUM)
    first, second = F.try_element_at(words, F.lit(2)), F.try_element_at(words, F.lit(3))
    valid = F.col("comment2")
    doubled = accepted_decisions(decisions).where(F.col("comment").contains(DOUBLED))
    return doubled.select(
        "new", "old", valid.alias("valid"),
        F.when(valid == first, second).when(valid != first, first).alias("invalid"),
    )


def apply_decisions(
    new: DataFrame, old: DataFrame, decisions: DataFrame, key: str, row_id: str
) -> tuple[DataFrame, DataFrame]:
    """Replace reviewed new keys by the old key agreed on, row by row on the
    key, and take out old records found to be invalid."""
    # Of several decisions on a key the least old key holds, so reruns agree.
    swap = accepted_decisions(decisions).groupBy(F.col("new").alias(key)).agg(F.min("old").alias("_old"))
    replaced = new.join(shuffled(swap), key, "left").withColumn(
        key, F.coalesce("_old", key)
    ).drop("_old").select(*new.columns)
    bad = invalid_duplicates(decisions).select(F.col("invalid").cast(old.schema[row_id].dataType).alias(row_id))
    kept = old.join(shuffled(bad.where(F.col(row_id).isNotNull()).distinct()), row_id, "left_anti").select(*old.columns)
    return replaced, kept
