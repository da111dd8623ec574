"""Caliper nearest-neighbour matching of treated rows to control rows.

A control is eligible for a treated row of the same stratum if every covariate
differs by at most the caliper, in SDs of the stratum. The match is the
eligible control with the smallest sum of squared SD-unit differences; ties are
kept, and the lowest control key comes first.

The number of eligible pairs grows with the square of the data, so pairs are
never listed. The search is a branch-and-bound over a k-d tree, run as joins:
split planes are medians of the controls, leaves are summarised once (count and
bounding box) and inner nodes are merged from them, a treated row takes a first
distance from the controls of its own leaf, and then goes down the tree with the
nodes that can still hold a nearer one. Equal covariate vectors are collapsed on
both sides first, so copies cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, fits
from .groups import group_counts
from .joins import attach_stats, join_suffixed
from .keys import running_number
from .reshape import to_long

# Calipers tried, in hundredths of an SD, and the one chosen.
CALIPERS = tuple(range(25, 101, 5))
CHOSEN_CALIPER = 70

TIE_TOLERANCE = 1e-5
SLACK = 1e-9
# Controls a leaf should hold, and how many times as many it may hold; controls that the
# upper planes are drawn from; levels of the tree that one join goes down.
LEAF_POINTS, OVERFULL, SAMPLE, FAN = 32, 4, 1 << 16, 4


def _names(letter: str, d: int) -> list[str]:
    return [f"{letter}{j}" for j in range(d)]


class _Planes:
    """Split planes of a balanced k-d tree, in heap order (the root is 1, children follow at
    twice its number): which covariate, and the value up to which rows go left."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.dim, self.value = np.zeros(1 << depth, int), np.full(1 << depth, np.inf)
        parts = {1: sample}
        for node in range(1, 1 << depth):
            own = parts.pop(node)
            parts[2 * node] = own
            parts[2 * node + 1] = own[:0]
            if len(own) > 1:
                j = int(np.ptp(own, axis=0).argmax())
                at = float(np.median(own[:, j]))
                # All that share the largest value go right together.
                at = at if at < own[:, j].max() else float((own[:, j].min() + own[:, j].max()) / 2)
                self.dim[node], self.value[node] = j, at
                right = own[:, j] > at
                parts[2 * node], parts[2 * node + 1] = own[~right], own[right]

    def leaf(self, d: int) -> Column:
        if not self.depth:
            return F.lit(1).cast("bigint")
        table = lambda values, kind: F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast(f"array<{kind}>")
        dim, value = table(self.dim, "int"), table(np.where(np.isfinite(self.value), self.value, 0), "double")
        split = table(np.isfinite(self.value).astype(int), "int")
        u = F.array(*[F.col(f"u{j}") for j in range(d)])
        right = lambda node: (F.get(split, node) == 1) & (F.get(u, F.get(dim, node)) > F.get(value, node))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(self.depth)), F.lit(1), lambda node, _: node * 2 + F.when(right(node), 1).otherwise(0)).cast("bigint")


def _with_leaves(controls: DataFrame, queries: DataFrame, n: int, d: int) -> tuple[DataFrame, DataFrame, int]:
    """Both tables with their leaf of one k-d tree over all strata, and its depth.

    The upper planes are medians of a bounded sample of the controls, ``SAMPLE`` of them with
    the smallest hashes; leaves that still hold many controls of a stratum are split on at
    medians computed in Spark, level by level.
    """
    depth = max(0, min(math.ceil(math.log2(max(n, 1) / LEAF_POINTS)), (SAMPLE // 8).bit_length() - 1))
    sample = np.zeros((0, d))
    if depth:
        drawn = controls.select(*_names("u", d))
        drawn = drawn if n <= SAMPLE else drawn.orderBy(F.xxhash64(*_names("u", d))).limit(SAMPLE)
        sample = np.stack([c.to_numpy() for c in drawn.toArrow().columns], 1)
    planes = _Planes(sample, depth)
    controls, queries = (cut(x.withColumn("leaf", planes.leaf(d))) for x in (controls, queries))
    while True:
        full = controls.groupBy("stratum", "leaf").count().where(F.col("count") > OVERFULL * LEAF_POINTS).select("leaf").distinct()
        spread = [F.struct((F.max(f"u{j}") - F.min(f"u{j}")).alias("w"), F.lit(j).alias("dim"), F.min(f"u{j}").alias("lo"),
                           F.max(f"u{j}").alias("hi"), F.percentile_approx(f"u{j}", F.lit(0.5), F.lit(1000)).alias("at")) for j in range(d)]
        widest = controls.join(full, "leaf", "left_semi").groupBy("leaf").agg(F.array_max(F.array(*spread)).alias("s"))
        middle = (F.col("s.lo") + F.col("s.hi")) / 2
        splits = cut(widest.select("leaf", F.col("s.dim").alias("_dim"), F.when(F.col("s.at") < F.col("s.hi"), F.col("s.at")).otherwise(middle).alias("_at")))
        if splits.isEmpty():
            return controls, queries, depth
        u = F.array(*[F.col(f"u{j}") for j in range(d)])
        down = F.col("leaf") * 2 + F.when(F.get(u, F.col("_dim")) > F.col("_at"), 1).otherwise(0)
        controls, queries = (cut(x.join(splits, "leaf", "left").withColumn("leaf", down).drop("_dim", "_at")) for x in (controls, queries))
        depth += 1


def _boxes(rows: DataFrame, d: int, up: int, fresh: bool) -> DataFrame:
    """Occupied nodes with count and bounding box, ``up`` levels above those of ``rows``:
    controls if ``fresh``, or boxes."""
    sides = [F.min(f"u{j}" if fresh else f"lo{j}").alias(f"lo{j}") for j in range(d)] + [
        F.max(f"u{j}" if fresh else f"hi{j}").alias(f"hi{j}") for j in range(d)]
    return rows.groupBy("stratum", F.shiftright("leaf", up).alias("leaf")).agg(
        (F.count(F.lit(1)) if fresh else F.sum("n")).alias("n"), *sides)


def _sum(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _most(parts: Sequence[Column]) -> Column:
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def _prune(frontier: DataFrame, d: int) -> DataFrame:
    """Drop nodes that cannot hold the nearest eligible control. ``best`` is a distance that
    is known to be reached; nodes wholly inside the caliper bring it down."""
    near = [
        F.greatest(F.col(f"lo{j}") - F.col(f"u{j}"), F.col(f"u{j}") - F.col(f"hi{j}"), F.lit(0.0))
        for j in range(d)
    ]
    far = [
        F.greatest(F.abs(F.col(f"u{j}") - F.col(f"lo{j}")), F.abs(F.col(f"u{j}") - F.col(f"hi{j}")))
        for j in range(d)
    ]
    bounded = (
        frontier.withColumn("_low", _sum([p * p for p in near]))
        .where((_most(near) <= F.col("cal") + SLACK) & (F.col("best").isNull() | (F.col("_low") <= F.col("best") + TIE_TOLERANCE + SLACK)))
        .withColumn("_high", F.when(_most(far) <= F.col("cal") - SLACK, _sum([p * p for p in far])))
    )
    # A query's nodes are few (that is what pruning ensures), so this window
    # never holds a large group.
    best = F.least("best", F.min("_high").over(Window.partitionBy("qid", "cal_id")))
    return (
        bounded.withColumn("best", best)
        .where(F.col("best").isNull() | (F.col("_low") <= F.col("best") + TIE_TOLERANCE + SLACK))
        .drop("_low", "_high")
    )


def _gaps(d: int) -> list[Column]:
    return [F.abs(F.col(f"u{j}") - F.col(f"v{j}")) for j in range(d)]


def open_leaves(queries: DataFrame, points: DataFrame, boxes: DataFrame, few_boxes: bool, d: int, depth: int) -> DataFrame:
    """The leaves that can hold the nearest eligible control of each (qid, cal_id), with ``n``.

    The controls of a query's own leaf give a first distance; then the query descends
    ``FAN`` levels a join, keeping nodes that can do better.
    """
    carry = ["qid", "cal_id", "cal", "stratum", *_names("u", d)]
    near = queries.select(*carry, "leaf").join(points, ["stratum", "leaf"]).where(_most(_gaps(d)) <= F.col("cal"))
    first = near.groupBy("qid", "cal_id").agg(F.min(_sum([g * g for g in _gaps(d)])).alias("best"))
    frontier = queries.select(*carry).join(first, ["qid", "cal_id"], "left")
    levels = list(range(depth, 0, -FAN))[::-1] or [0]
    for i, level in enumerate(levels):
        nodes = _boxes(boxes, d, depth - level, False)
        nodes = nodes.hint("broadcast") if few_boxes else nodes
        if i:
            nodes = nodes.withColumn("_up", F.shiftright("leaf", level - levels[i - 1]))
            frontier = frontier.select(*carry, "best", F.col("leaf").alias("_up")).join(nodes, ["stratum", "_up"])
        else:
            frontier = frontier.join(nodes, "stratum")
        frontier = cut(_prune(frontier.select(*carry, "best", "leaf", "n", *_names("lo", d), *_names("hi", d)), d))
    return frontier.select(*carry, "leaf", "n")


class _Controls:
    """Control vectors laid out by leaf, with the boxes of the leaves."""

    def __init__(self, controls: DataFrame, depth: int, d: int):
        self.depth, self.d = depth, d
        self.few = fits(controls)
        self.boxes = cut(_boxes(controls, d, 0, True))
        self.few_boxes = fits(self.boxes)
        points = controls.select("stratum", "leaf", "ckey", "copies", *[F.col(f"u{j}").alias(f"v{j}") for j in range(d)])
        self.points = points.hint("broadcast") if self.few else points

    def search(self, queries: DataFrame) -> DataFrame:
        """Nearest eligible control vectors of each (qid, cal_id), ties kept."""
        d = self.d
        pairs = (
            open_leaves(queries, self.points, self.boxes, self.few_boxes, d, self.depth)
            .join(self.points, ["stratum", "leaf"])
            .withColumn("needed", _most(_gaps(d)))
            .where(F.col("needed") <= F.col("cal"))
            .withColumn("dist", _sum([g * g for g in _gaps(d)]))
        )
        nearest = F.min("dist").over(Window.partitionBy("qid", "cal_id"))
        return (
            pairs.withColumn("_min", nearest)
            .where(F.col("dist") <= F.col("_min") + TIE_TOLERANCE)
            .withColumn("at_min", F.col("dist") == F.col("_min"))
            .select("qid", "cal_id", "ckey", "copies", "dist", "needed", "at_min")
        )


def scaled_rows(
    frame: DataFrame, key: str, treated: str, stratum: str, covariates: Sequence[str],
) -> DataFrame:
    """Complete rows with covariates in SDs of their stratum, materialised: ``key``,
    ``treated``, ``stratum``, ``u0``... Vectors are equal if these are."""
    d = len(covariates)
    data = frame.select(
        F.col(key).alias("key"), F.col(treated).alias("treated"), F.col(stratum).alias("stratum"),
        *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(covariates)],
    ).dropna()
    sds = data.groupBy("stratum").agg(*[F.stddev_samp(f"x{j}").alias(f"sd{j}") for j in range(d)])
    return cut(attach_stats(data, sds, ["stratum"]).select(
        "key", "treated", "stratum",
        *[F.coalesce(F.try_divide(f"x{j}", f"sd{j}"), F.lit(0.0)).alias(f"u{j}") for j in range(d)],
    ))


def sweep(
    frame: DataFrame, key: str, treated: str, stratum: str, covariates: Sequence[str],
    calipers: Sequence[int] = CALIPERS, scaled: DataFrame | None = None,
) -> DataFrame:
    """Match at every caliper. Returns one row per (caliper, treated row, tied
    control vector): ``caliper`` (hundredths), ``stratum``, ``treated``,
    ``control`` (lowest key of the vector), ``copies``, ``dist``, ``needed``.

    The widest caliper is searched first. A nearest control that also meets a
    narrower caliper is the answer there too, so only the calipers it misses
    are searched again. ``scaled`` hands over rows of :func:`scaled_rows`.
    """
    d = len(covariates)
    scaled = scaled_rows(frame, key, treated, stratum, covariates) if scaled is None else scaled
    vector = ["stratum", *_names("u", d)]
    controls = cut(scaled.where(~F.col("treated")).groupBy(*vector).agg(
        F.min("key").alias("ckey"), F.count(F.lit(1)).alias("copies")
    ))
    queries = scaled.where("treated").groupBy(*vector).agg(F.min("key").alias("qid"))
    controls, queries, depth = _with_leaves(controls, queries, controls.count(), d)
    laid = _Controls(controls, depth, d)
    widest = max(calipers)

    first = cut(laid.search(queries.withColumn("cal_id", F.lit(widest)).withColumn("cal", F.lit(widest / 100.0))))
    reach = first.where("at_min").groupBy("qid").agg(F.min("needed").alias("reach"))
    asked = queries.join(reach, "qid").select(
        "*", F.explode(F.array(*[F.lit(c) for c in sorted(calipers)])).alias("cal_id")
    ).withColumn("cal", F.col("cal_id") / F.lit(100.0))
    ready = asked.where(F.col("cal") >= F.col("reach")).select("qid", "cal_id", "cal").join(
        first.drop("cal_id", "at_min"), "qid"
    ).where(F.col("needed") <= F.col("cal")).drop("cal")
    again = cut(asked.where(F.col("cal") < F.col("reach")).drop("reach"))
    found = ready
    if not again.isEmpty():
        found = ready.unionByName(laid.search(again).drop("at_min"))

    who = scaled.where("treated").join(queries, vector).select(
        F.col("key").alias("treated"), "stratum", "qid"
    )
    return found.join(who, "qid").select(
        F.col("cal_id").alias("caliper"), "stratum", "treated", F.col("ckey").alias("control"),
        "copies", "dist", "needed",
    )


def first_ties(vectors: DataFrame) -> DataFrame:
    """One row per caliper and treated row: the lowest control key among its
    ties, and the number of tied control rows."""
    return vectors.groupBy("caliper", "stratum", "treated").agg(
        F.min("control").alias("control"),
        F.sum("copies").alias("n_ties"),
        F.min("dist").alias("dist"),
    )


def numbered_ties(vectors: DataFrame, scaled: DataFrame) -> DataFrame:
    """Every tied control row of every treated row, numbered by distance, then
    vector, then key. ``scaled`` are the rows that ``vectors`` were found from.

    Copies are numbered once per vector and shifted by the copies of the
    vectors before it, so a hot vector is never sorted per treated row.
    """
    same = ["stratum", *[c for c in scaled.columns if c.startswith("u")]]
    controls = scaled.where(~F.col("treated")).select(*same, F.col("key").alias("member"))
    numbered = running_number(controls, same, ["member"], "place")
    first = numbered.where("place = 1").select(*same, F.col("member").alias("control"))
    members = numbered.join(first, same).select("control", "member", "place")
    earlier = (
        Window.partitionBy("caliper", "treated").orderBy("dist", "control")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifted = vectors.withColumn("_before", F.coalesce(F.sum("copies").over(earlier), F.lit(0)))
    return shifted.join(members, "control").select(
        "caliper", "stratum", "treated", F.col("member").alias("control"), "dist",
        (F.col("_before") + F.col("place")).alias("match_rank"),
    )


def at_caliper(matches: DataFrame, hundredths: int = CHOSEN_CALIPER) -> DataFrame:
    return matches.where(F.col("caliper") == hundredths)


def twin_values(
    pairs: DataFrame, frame: DataFrame, key: str, covariates: Sequence[str]
) -> DataFrame:
    """Both rows' covariates next to each pair, as ``_x`` (treated) and ``_y``."""
    values = frame.select(key, *covariates)
    left = join_suffixed(pairs, values, "treated", key)
    return join_suffixed(left, values, "control", key)


def deviations(
    pairs: DataFrame, frame: DataFrame, key: str, stratum: str, covariates: Sequence[str]
) -> DataFrame:
    """Absolute difference of the twins per covariate, raw and in SDs of the
    stratum."""
    both = twin_values(pairs, frame, key, covariates)
    sds = frame.groupBy(F.col(stratum).alias("stratum")).agg(
        *[F.stddev_samp(c).alias(f"{c}_sd") for c in covariates]
    )
    gap = {f"{c}_dev": F.abs(F.col(f"{c}_x") - F.col(f"{c}_y")) for c in covariates}
    out = attach_stats(both, sds, ["stratum"]).withColumns(gap)
    out = out.withColumns({
        f"{c}_devz": F.try_divide(F.col(f"{c}_dev"), F.col(f"{c}_sd")) for c in covariates
    })
    return out.drop(*[f"{c}_sd" for c in covariates])


def deviation_summary(dev: DataFrame, covariates: Sequence[str], by: Sequence[str]) -> DataFrame:
    long = to_long(dev, by, [f"{c}_devz" for c in covariates])
    return long.groupBy(*by).agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )


def retention(
    frame: DataFrame, treated: str, stratum: str, matches: DataFrame
) -> DataFrame:
    """Treated and matched rows per caliper and stratum; strata without any
    match show 0."""
    asked = group_counts(frame.where(F.col(treated)), stratum, name="n_treated").withColumnRenamed(
        stratum, "stratum"
    )
    got = matches.groupBy("caliper", "stratum").agg(F.count_distinct("treated").alias("n_matched"))
    grid = asked.withColumn("caliper", F.explode(F.array(*[F.lit(c) for c in CALIPERS])))
    return grid.join(got, ["caliper", "stratum"], "left").select(
        "caliper", "stratum", "n_treated",
        F.coalesce("n_matched", F.lit(0)).cast("bigint").alias("n_matched"),
        (F.coalesce("n_matched", F.lit(0)) / F.col("n_treated")).alias("share"),
    )
