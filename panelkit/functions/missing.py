"""Missing-value rules for survey data, where NULL means "no answer".

Spark's own rules differ in places that silently drop rows or invent answers;
each helper states which behaviour it gives.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = str | Column


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_match(c: ColumnLike, pattern: str, ignore_case: bool = False) -> Column:
    """Regex search that is false, never NULL, for a missing text."""
    flag = "(?i)" if ignore_case else ""
    return F.coalesce(as_col(c).rlike(flag + pattern), F.lit(False))


def member(c: ColumnLike, values: Iterable) -> Column:
    """List membership that is false, never NULL, for a missing value."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice; an unknown condition gives NULL rather than ``no``."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond, yes).when(~cond, no)


def any_null(cols: Sequence[ColumnLike]) -> Column:
    return reduce(lambda a, b: a | b, [as_col(c).isNull() for c in cols])


def all_null(cols: Sequence[ColumnLike]) -> Column:
    return reduce(lambda a, b: a & b, [as_col(c).isNull() for c in cols])


def strict_sum(cols: Sequence[ColumnLike]) -> Column:
    """Row sum; NULL as soon as one part is missing."""
    return reduce(lambda a, b: a + b, [as_col(c).cast("double") for c in cols])


def strict_mean(cols: Sequence[ColumnLike]) -> Column:
    return strict_sum(cols) / F.lit(float(len(cols)))


def strict_max(cols: Sequence[ColumnLike]) -> Column:
    """Row maximum; NULL as soon as one part is missing."""
    cols = [as_col(c) for c in cols]
    return F.when(~any_null(cols), F.greatest(*cols))


def present_count(cols: Sequence[ColumnLike]) -> Column:
    return reduce(lambda a, b: a + b, [as_col(c).isNotNull().cast("int") for c in cols])


def present_sum(cols: Sequence[ColumnLike]) -> Column:
    """Row sum of the answers given; 0 when there is none."""
    return reduce(
        lambda a, b: a + b,
        [F.coalesce(as_col(c).cast("double"), F.lit(0.0)) for c in cols],
    )


def present_mean(cols: Sequence[ColumnLike]) -> Column:
    """Row mean of the answers given; NULL when there is none."""
    return F.try_divide(present_sum(cols), present_count(cols))


def paste(cols: Sequence[ColumnLike], sep: str = " ", missing: str = "NA") -> Column:
    """Join texts, spelling out missing parts so positions stay fixed."""
    return F.concat_ws(sep, *[F.coalesce(as_col(c).cast("string"), F.lit(missing)) for c in cols])
