"""Internal consistency of an item set."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import strict_sum


def cronbach_alpha(df: DataFrame, items: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Cronbach's alpha in one aggregation.

    Item variances use every answer given; the total's variance uses rows
    answered completely.
    """
    k = float(len(items))
    total = strict_sum(items)
    parts = reduce(lambda a, b: a + b, [F.var_samp(c) for c in items])
    return df.groupBy(*by).agg(
        F.count(total).alias("n"),
        (F.lit(k / (k - 1)) * (1 - F.try_divide(parts, F.var_samp(total)))).alias("alpha"),
    )
