"""Numbers: rounding, significant digits, sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import ColumnLike, as_col


def round_half_even(c: ColumnLike, digits: int = 0) -> Column:
    return F.bround(as_col(c), digits)


def signif(c: ColumnLike, digits: int = 3) -> Column:
    """Round to significant digits; zero stays zero."""
    c = as_col(c)
    scale = F.pow(F.lit(10.0), F.lit(float(digits)) - F.ceil(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.rint(c * scale) / scale)


def hundredths(start: int, stop: int, step: int) -> Column:
    """A number sequence held as whole hundredths, free of rounding drift."""
    return F.sequence(F.lit(start), F.lit(stop), F.lit(step))
