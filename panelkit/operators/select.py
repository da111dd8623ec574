"""Column selection by pattern, position and set algebra."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Selector:
    """A rule that picks column names, resolved while the plan is built."""

    def __init__(self, pick: Callable[[list[str]], list[str]]):
        self.pick = pick

    def __call__(self, df: DataFrame) -> list[str]:
        return self.pick(list(df.columns))

    def __or__(self, other: "Selector") -> "Selector":
        return Selector(lambda cols: list(dict.fromkeys(self.pick(cols) + other.pick(cols))))

    def __and__(self, other: "Selector") -> "Selector":
        return Selector(lambda cols: [c for c in self.pick(cols) if c in set(other.pick(cols))])

    def __sub__(self, other: "Selector") -> "Selector":
        return self & ~other

    def __invert__(self) -> "Selector":
        return Selector(lambda cols: [c for c in cols if c not in set(self.pick(cols))])


def where_name(test: Callable[[str], bool]) -> Selector:
    return Selector(lambda cols: [c for c in cols if test(c)])


def starts_with(text: str) -> Selector:
    return where_name(lambda c: c.lower().startswith(text.lower()))


def ends_with(text: str) -> Selector:
    return where_name(lambda c: c.lower().endswith(text.lower()))


def contains(text: str) -> Selector:
    return where_name(lambda c: text.lower() in c.lower())


def matches(pattern: str) -> Selector:
    return where_name(lambda c: re.search(pattern, c, re.IGNORECASE) is not None)


def any_of(*names: str) -> Selector:
    """The named columns that exist."""
    return Selector(lambda cols: [n for n in names if n in cols])


def all_of(*names: str) -> Selector:
    def pick(cols: list[str]) -> list[str]:
        absent = [n for n in names if n not in cols]
        if absent:
            raise KeyError(f"no such columns: {absent}")
        return list(names)

    return Selector(pick)


def between(first: str, last: str) -> Selector:
    """Columns from ``first`` to ``last`` in table order."""
    return Selector(lambda cols: cols[cols.index(first): cols.index(last) + 1])


def everything() -> Selector:
    return Selector(lambda cols: cols)


def select(df: DataFrame, *rules: Selector | str) -> DataFrame:
    names: list[str] = []
    for rule in rules:
        names += [rule] if isinstance(rule, str) else rule(df)
    return df.select(*dict.fromkeys(names))


def drop(df: DataFrame, *rules: Selector | str) -> DataFrame:
    gone: set[str] = set()
    for rule in rules:
        gone |= {rule} if isinstance(rule, str) else set(rule(df))
    return df.drop(*gone)


def to_front(df: DataFrame, *rules: Selector | str) -> DataFrame:
    return select(df, *rules, everything())


def sort_columns(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))


def rename_with(
    df: DataFrame, fn: Callable[[str], str], rule: Selector | None = None
) -> DataFrame:
    chosen = set((rule or everything())(df))
    return df.toDF(*[fn(c) if c in chosen else c for c in df.columns])


def add_suffix(df: DataFrame, suffix: str, keep: Iterable[str] = ()) -> DataFrame:
    return rename_with(df, lambda c: c + suffix, ~any_of(*keep))


def across(
    df: DataFrame, rule: Selector, fn: Callable[[Column], Column], name: str = "{col}"
) -> DataFrame:
    """Apply one function to each chosen column, in place or to new names."""
    return df.withColumns({name.format(col=c): fn(F.col(c)) for c in rule(df)})
