"""Exact quantiles by radix selection: four counting passes, whatever the size of a group.

A double has a 64-bit code that sorts as it does. Each pass counts one 16-bit digit of
the code (a map-side combined aggregation of at most 65,536 rows per group and prefix)
and narrows every wanted rank to one value of the digit; after four digits a rank is a
value. A rank is settled earlier when its part of the codes holds one value. No row
moves, no group is sorted or gathered, and a group of ten rows takes the same path as
one of ten billion, so equal values give bit-equal quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, cut, measured

DIGIT = 16
# Smallest normal double, and the exponent and mantissa sizes of the format.
_NORMAL, _BIAS, _FRACTION = 2.0**-1022, 1023, 52


def with_code(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add ``name``, a long that sorts as the double ``value`` does, for every value but
    NaN; -0.0 is 0.0.

    It is the sign times the IEEE bits of the size, by exact arithmetic: a factor that is
    a power of two never rounds, so only the guess of the exponent has to be put right,
    which is one step too high or too low near powers of two. Each step is a projection of
    its own, so nothing is computed twice.
    """
    v, power = F.col(value), lambda e: F.pow(F.lit(2.0), -e)
    guess = df.select("*", F.abs(v).alias("_size"), F.least(F.floor(F.log2(F.abs(v))), F.lit(_BIAS)).cast("double").alias("_e"))
    part = guess.withColumn("_part", F.col("_size") * power(F.col("_e")))
    step = F.when(F.col("_part") >= 2, 1.0).when(F.col("_part") < 1, -1.0).otherwise(0.0)
    right = part.select("*", step.alias("_step"))
    mantissa = F.col("_part") * F.when(F.col("_step") == 0, 1.0).when(F.col("_step") > 0, 0.5).otherwise(2.0)
    normal = (F.col("_e") + F.col("_step") + (_BIAS - 1)).cast("long") * F.lit(1 << _FRACTION) + (mantissa * F.lit(2.0**_FRACTION)).cast("long")
    bits = F.when(F.col("_size") == float("inf"), F.lit(2047 << _FRACTION)).when(
        F.col("_size") < _NORMAL, (F.col("_size") * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")).otherwise(normal)
    out = right.withColumn(name, bits)
    return out.withColumn(name, F.when(v < 0, -F.col(name)).otherwise(F.col(name))).select(*df.columns, name)


def _same(keys: Sequence[str], right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{right}{k}")) for k in keys])


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with columns ``by``, ``n`` and ``q`` (array, in the order of
    ``probs``), interpolating linearly between order statistics.

    NULL and NaN are skipped; a group without values has NULL quantiles. Infinite values
    rank like others; half way between -inf and inf is NaN.
    """
    number = F.nanvl(F.col(value).cast("double"), F.lit(None))
    values = df.select(*by, F.when(number == 0, F.lit(0.0)).otherwise(number).alias("_v"))
    # A constant group column keeps the ungrouped case an equi-join.
    groups = list(by) or ["_g"]
    values = with_code(values if by else values.withColumn("_g", F.lit(0)), "_v", "_c").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        state = cut(_first(values, groups, probs))
        for digits in (1, 2, 3):
            open_ranks = state.where("lo < hi").select(
                *[F.col(g).alias(f"_s_{g}") for g in groups], F.col("prefix").alias("_s_prefix")).distinct()
            size = measured(open_ranks)
            if not size:
                break
            if size <= BROADCAST_BYTES:
                open_ranks = F.broadcast(open_ranks)
            state = cut(_narrow(values, state, open_ranks, groups, 64 - DIGIT * digits))
    finally:
        values.unpersist()
    # One row per group and rank end: each aggregate below sees one value.
    own = lambda c, i, up: F.max(F.when((F.col("i") == i) & (F.col("up") == up), F.col(c)))

    def between(i: int) -> Column:
        low, high, share = own("lo", i, 0), own("lo", i, 1), own("h", i, 0) % 1
        # Weights, not a difference: one infinite end gives an infinite value.
        return F.when((low == high) | (share == 0), low).otherwise(low * (1 - share) + high * share)

    return state.groupBy(*groups, "n").agg(F.array(*[between(i) for i in range(len(probs))]).alias("q")).select(
        *by, "n", F.when(F.col("n") > 0, F.col("q")).alias("q"))


def _counted(values: DataFrame, keys: list[str], shift: int) -> DataFrame:
    """Rows and range of the values of each next digit, and how many values come before."""
    counts = values.groupBy(*keys, F.shiftright("_c", shift).alias("prefix")).agg(
        F.count("_v").alias("size"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    # At most 2^16 rows of a group and prefix.
    part = Window.partitionBy(*keys).orderBy("prefix")
    frame = lambda end: part.rowsBetween(Window.unboundedPreceding, end)
    return counts.select("*", F.sum("size").over(frame(Window.currentRow)).alias("upto"), F.sum("size").over(frame(Window.unboundedFollowing)).alias("n"))


def _first(values: DataFrame, groups: list[str], probs: Sequence[float]) -> DataFrame:
    placed = _counted(values, groups, 64 - DIGIT)
    h = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    wanted = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), h[i].alias("h"), (F.ceil(h[i]) if up else F.floor(h[i])).cast("bigint").alias("left"))
        for i in range(len(probs)) for up in (0, 1)
    ])
    here = F.filter(wanted, lambda s: (s["left"] >= F.col("upto") - F.col("size")) & (s["left"] < F.col("upto")))
    # A group without values keeps a row; it has one count, of no digit.
    return placed.select(*groups, "n", "lo", "hi", "prefix", (F.col("upto") - F.col("size")).alias("_below"), F.explode_outer(
        F.when(F.col("n") > 0, here).otherwise(F.slice(wanted, 1, 1))).alias("w")).where("w IS NOT NULL").select(
        *groups, "n", "lo", "hi", "prefix", F.col("w.h").alias("h"), (F.col("w.left") - F.col("_below")).alias("left"),
        F.col("w.i").alias("i"), F.col("w.up").alias("up"))


def _narrow(values: DataFrame, state: DataFrame, open_ranks: DataFrame, groups: list[str], shift: int) -> DataFrame:
    """Rank the values that share a prefix with an open rank by the next digit."""
    inside = _same(groups, "_s_") & (F.shiftright("_c", shift) == F.col("_s_prefix"))
    placed = _counted(values.join(open_ranks, inside).select(*groups, "_s_prefix", "_v", "_c"), [*groups, "_s_prefix"], shift - DIGIT).select(
        *[F.col(g).alias(f"_b_{g}") for g in groups], "_s_prefix", F.col("lo").alias("_b_lo"), F.col("hi").alias("_b_hi"),
        F.col("prefix").alias("_b_prefix"), "upto", (F.col("upto") - F.col("size")).alias("_below"))
    hit = (_same(groups, "_b_") & (F.col("prefix") == F.col("_s_prefix"))
           & (F.col("left") >= F.col("_below")) & (F.col("left") < F.col("upto")))
    moved = state.where("lo < hi").join(placed, hit).select(
        *groups, "n", F.col("_b_lo").alias("lo"), F.col("_b_hi").alias("hi"), F.col("_b_prefix").alias("prefix"), "h",
        (F.col("left") - F.col("_below")).alias("left"), "i", "up")
    return state.where("NOT (lo < hi) OR lo IS NULL").select(*moved.columns).unionByName(moved)


def median(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    q = quantiles(df, value, [0.5], by)
    return q.select(*by, F.col("q")[0].alias(name))
