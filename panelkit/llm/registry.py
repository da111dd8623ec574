"""Queries of this folder: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import load, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, table: str, sql: str | None = None):
    """Register a function of one table and the session."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(load(prepare(spark), sf_dir, table), sf_dir)
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return add
