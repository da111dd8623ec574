"""Row filters with explicit missing-value behaviour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import any_null, member, text_match


def drop_matching(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Drop rows whose text matches, ignoring case; missing texts stay."""
    return df.where(~text_match(col, pattern, ignore_case=True))


def keep_matching(df: DataFrame, col: str, pattern: str) -> DataFrame:
    return df.where(text_match(col, pattern, ignore_case=True))


def keep_present(df: DataFrame, *cols: str) -> DataFrame:
    return df.where(~any_null(cols))


def keep_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return df.where(member(col, values))


def drop_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Drop listed values; missing values stay."""
    return df.where(~member(col, values))


def complete_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Listwise deletion."""
    return df.dropna("any", subset=list(cols) if cols is not None else None)


def incomplete_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.where(any_null(cols or df.columns))


def not_category(df: DataFrame, col: str, value) -> DataFrame:
    """Drop one category; missing values go too."""
    return df.where(F.col(col) != F.lit(value))


