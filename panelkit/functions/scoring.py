"""Item scoring: reversal, prorated sums, composites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import ColumnLike, as_col, present_count, present_sum, strict_mean, strict_sum

# Fixed value: largest share of unanswered items a score may have.
MISSING_LIMIT = 0.2


def missing_share(items: Sequence[ColumnLike]) -> Column:
    k = len(items)
    return (F.lit(k) - present_count(items)) / F.lit(float(k))


def least_answers(k: int, limit: float) -> int:
    """Fewest answers out of ``k`` that keep the missing share within the
    limit; at least one."""
    return max(1, min(n for n in range(k + 1) if (k - n) / k <= limit))


def prorated_sum(items: Sequence[ColumnLike], limit: float = 1.0) -> Column:
    """Mean of the answers given times the item count.

    NULL if the share of unanswered items is over ``limit`` (strictly), or if
    nothing was answered.
    """
    k = len(items)
    n = present_count(items)
    return F.when(n >= least_answers(k, limit), present_sum(items) / n * F.lit(float(k)))


def shift(item: ColumnLike, by: int = -1) -> Column:
    return as_col(item) + F.lit(by)


def reverse(item: ColumnLike, low_plus_high: int) -> Column:
    """Mirror an item inside its answer range."""
    return F.lit(low_plus_high) - as_col(item)


def mean_item(items: Sequence[ColumnLike], limit: float = 1.0) -> Column:
    return prorated_sum(items, limit) / F.lit(float(len(items)))


def composite(z_scores: Sequence[ColumnLike]) -> Column:
    """Mean of standardised scales, NULL if one is missing."""
    return strict_mean(z_scores)


__all__ = [
    "MISSING_LIMIT", "missing_share", "prorated_sum", "shift", "reverse", "mean_item",
    "composite", "strict_mean", "strict_sum",
]
