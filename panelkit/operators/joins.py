"""Joins on subject keys, one-row constants and wave frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side


def null_safe_on(left: DataFrame, right: DataFrame, pairs: Mapping[str, str]) -> Column:
    """Equality that also pairs missing keys with missing keys."""
    return reduce(
        lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs.items()]
    )


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every column the two tables share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column")
    return left.join(right, shared, how)


def join_suffixed(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "left",
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Join on differently named keys; clashing columns get suffixes."""
    clash = [c for c in left.columns if c in right.columns and c != right_key]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    right = right.withColumnRenamed(right_key, "_right_key")
    left_key = left_key + suffixes[0] if left_key in clash else left_key
    return left.join(right, F.col(left_key) == F.col("_right_key"), how).drop("_right_key")


def keep_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return df.join(members.select(key).distinct(), key, "left_semi")


def drop_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``members``; rows with a missing key stay."""
    return df.join(members.select(key).distinct(), key, "left_anti")


def constant(one_row: DataFrame, column: str) -> Column:
    """A value of a one-row table as a scalar subquery (no join)."""
    return one_row.select(column).scalar()


def attach_stats(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add per-group values to the rows of each group.

    The aggregate is joined back instead of using a window, so rows are never
    gathered by group; a group of any size costs the same.
    """
    renamed = small_side(stats.withColumnsRenamed({b: f"_by_{b}" for b in by}))
    on = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by])
    return df.join(renamed, on, "left").drop(*[f"_by_{b}" for b in by])


def wave_frame(
    long: DataFrame, key: str, wave: str, waves: Sequence[int], values: Sequence[str],
    suffix: str = "_t", complete: bool = True,
) -> DataFrame:
    """One row per subject with each value at each wave, in a single shuffle.

    ``complete`` keeps subjects seen at every wave. (key, wave) must be unique.
    """
    aggs = [
        F.max(F.when(F.col(wave) == w, F.col(v))).alias(f"{v}{suffix}{w}")
        for v in values
        for w in waves
    ]
    seen = [F.max((F.col(wave) == w).cast("int")).alias(f"_seen_{w}") for w in waves]
    out = long.where(F.col(wave).isin(list(waves))).groupBy(key).agg(*aggs, *seen)
    if complete:
        out = out.where(reduce(lambda a, b: a & b, [F.col(f"_seen_{w}") == 1 for w in waves]))
    return out.drop(*[f"_seen_{w}" for w in waves])


def add_changes(
    wide: DataFrame, values: Sequence[str], later: int, earlier: int, suffix: str = "_t"
) -> DataFrame:
    """Change score of each value between two waves."""
    return wide.withColumns({
        f"{v}{suffix}{later}minus{suffix[1:]}{earlier}":
            F.col(f"{v}{suffix}{later}") - F.col(f"{v}{suffix}{earlier}")
        for v in values
    })
