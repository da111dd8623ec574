"""Codes to labels, flags, bins, marks and report strings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import ColumnLike, as_col

# Significance marks and the p value each one needs.
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))
GRADED_STARS = STARS + ((0.1, "#"), (0.2, "##"))


def label(c: ColumnLike, codes: Mapping, other: str | None = None) -> Column:
    """Code to label; an unknown code gives NULL unless ``other`` is set, and
    a missing code always gives NULL."""
    c = as_col(c)
    out = F
    for code, text in codes.items():
        out = out.when(c == F.lit(code), F.lit(text))
    return out.when(c.isNotNull(), F.lit(other)) if other is not None else out


def first_true(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """First rule whose condition holds; unknown conditions do not hold."""
    out = F
    for cond, value in rules:
        out = out.when(cond, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(F.lit(default))


def yes_no(flags: Sequence[ColumnLike], yes=2, no=1) -> Column:
    """"yes" if any flag says so, else "no" if any says so, else NULL."""
    flags = [as_col(f) for f in flags]
    says = lambda code: reduce(lambda a, b: a | b, [f == code for f in flags])
    return F.when(says(yes), "yes").when(says(no), "no")


def severest(flags: Sequence[ColumnLike], set_value=2) -> Column:
    """Rank of the severest flag set, 0 for none.

    Flags run from mildest to severest and are read from the severe end; a
    missing flag ends the search with NULL.
    """
    out = F
    for rank in range(len(flags), 0, -1):
        f = as_col(flags[rank - 1])
        out = out.when(f.isNull(), F.lit(None).cast("int")).when(f == set_value, F.lit(rank))
    return out.otherwise(F.lit(0))


def three_bins(c: ColumnLike, low=1, high=5) -> Column:
    """1 at the low end, 2 between, 3 at the high end, NULL outside."""
    c = as_col(c)
    return F.when(c == low, 1).when((c > low) & (c < high), 2).when(c == high, 3)


def two_bins(c: ColumnLike, split: float, low: int = 1, high: int = 2) -> Column:
    """``low`` below the split point and ``high`` above it."""
    c = as_col(c)
    return F.when(c < split, F.lit(low)).when(c > split, F.lit(high))


def over_any(limits: Mapping[str, float]) -> Column:
    """Clinical flag: any value at or over its limit (three-valued OR)."""
    return reduce(lambda a, b: a | b, [F.col(c) >= v for c, v in limits.items()])


def stars(p: ColumnLike, marks=STARS) -> Column:
    """Significance marks, strictly below each limit."""
    p = as_col(p)
    out = F
    for limit, mark in marks:
        out = out.when(p < limit, F.lit(mark))
    return out.otherwise(F.lit(""))


def level_order(c: ColumnLike, levels: Sequence[str]) -> Column:
    """Position of a category in its level list, for sorting."""
    return label(c, {v: i for i, v in enumerate(levels)})


def _p_text(p: Column) -> Column:
    return F.when(p < 0.001, F.lit("p < .001")).otherwise(F.format_string("p = %.3f", p))


def report_t(t: str, df: str, p: str, d: str, lo: str, hi: str) -> Column:
    """Report string of a t test with effect size and interval."""
    return F.concat_ws(
        ", ",
        F.format_string("t(%.0f) = %.2f", F.col(df), F.col(t)),
        _p_text(F.col(p)),
        F.format_string("d = %.2f [%.2f; %.2f]", F.col(d), F.col(lo), F.col(hi)),
    )


def report_r(r: str, df: str, p: str, lo: str, hi: str) -> Column:
    """Report string of a correlation test."""
    return F.concat_ws(
        ", ",
        F.format_string("r(%.0f) = %.2f [%.2f; %.2f]", F.col(df), F.col(r), F.col(lo), F.col(hi)),
        _p_text(F.col(p)),
    )


def report_f(f: str, df1: str, df2: str, p: str, ges: str) -> Column:
    """Report string of a model term."""
    return F.concat_ws(
        ", ",
        F.format_string("F(%.2f, %.2f) = %.2f", F.col(df1), F.col(df2), F.col(f)),
        _p_text(F.col(p)),
        F.format_string("ges = %.3f", F.col(ges)),
    )
