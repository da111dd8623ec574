"""Registered queries: a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from .panel import VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Put the derived tables a query mentions in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    head = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under a name."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(prepare(spark), sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison; keeps the name of a named column."""
    if isinstance(c, str):
        return F.round(F.col(c), digits).alias(c)
    return F.round(c, digits)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column."""
    return df.select(*[
        r(c, special.get(c, digits)) if t == "double" else F.col(c) for c, t in df.dtypes
    ])
