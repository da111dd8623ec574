"""Writers; every one is a distributed table write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import QUOTING


def escaped(df: DataFrame) -> DataFrame:
    """Line breaks in text as ``\\n`` and ``\\r``, backslashes as ``\\e``, so that a row
    stays a line and files can be split."""
    def plain(c):
        c = F.replace(F.col(c), F.lit("\\"), F.lit("\\e"))
        return F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))

    return df.select(*[plain(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_decimal_comma_csv(df: DataFrame, path: str, missing: str = "") -> None:
    """``;``-separated CSV with a decimal comma, for spreadsheets."""
    out = escaped(df).select(*[
        F.replace(F.col(f.name).cast("string"), F.lit("."), F.lit(",")).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)) else F.col(f.name)
        for f in df.schema
    ])
    out.write.options(header=True, sep=";", nullValue=missing, emptyValue='""', **QUOTING).csv(path)


def write_quoted(df: DataFrame, path: str, sep: str = ";") -> None:
    """Delimited text as other programs write it: line breaks stay inside quotes. Read it
    with :func:`panelkit.sources.quoted.read_quoted`."""
    df.write.options(header=True, sep=sep, quoteAll=True, lineSep="\n", **QUOTING).csv(path)


def write_tsv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    writer = escaped(df).write.options(header=True, sep="\t", encoding=encoding, **QUOTING)
    if encoding.upper().startswith("UTF-16"):
        writer = writer.option("lineSep", "\n")
    writer.csv(path)


def write_candidates(pairs: DataFrame, path: str) -> None:
    """Candidate pairs for review, in one folder per concordance.

    Rows are range-partitioned on (concordance, new, old): a key's candidates
    lie together, a key with very many spreads over files, and the number of
    files does not grow with the number of keys.
    """
    (
        escaped(pairs).repartitionByRange("concordance", "new", "old")
        .sortWithinPartitions("concordance", "new", "old")
        .write.partitionBy("concordance").options(header=True, sep=";", **QUOTING).csv(path)
    )


def write_review_lists(lists: DataFrame, members: DataFrame, path: str) -> None:
    """Factorised candidates for review: ``lists`` in one folder per concordance, a code's rows
    together, and ``members`` by combination. Rows grow with the codes, not with the pairs."""
    rows = escaped(lists).repartitionByRange("concordance", "new").sortWithinPartitions("concordance", "new", "before")
    rows.write.partitionBy("concordance").options(header=True, sep=";", **QUOTING).csv(f"{path}/lists")
    held = escaped(members).repartitionByRange("combo", "place").sortWithinPartitions("combo", "place")
    held.write.options(header=True, sep=";", **QUOTING).csv(f"{path}/members")


def write_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back, free of its lineage."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
