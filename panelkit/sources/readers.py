"""Readers with declared schemas; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_side

CODES_HELD = 20_000  # of all columns, in one dictionary inside the plan
CODES_SEARCHED = 256  # of one column; beyond them its labels are joined


# Quotes in text are doubled, so a backslash is an ordinary character.
QUOTING = {"escape": '"'}


def _unescaped(df: DataFrame) -> DataFrame:
    """Undo :func:`panelkit.sources.writers.escaped` in every text column."""
    def plain(c):
        c = F.replace(F.col(c), F.lit("\\n"), F.lit("\n"))
        return F.replace(F.replace(c, F.lit("\\r"), F.lit("\r")), F.lit("\\e"), F.lit("\\"))

    return df.select(*[plain(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def read_decimal_comma_csv(
    spark: SparkSession, path: str, schema: T.StructType,
    timestamp_format: str | None = None, escaped: bool = False,
) -> DataFrame:
    """``;``-separated CSV whose numbers use a decimal comma (and may use points between
    thousands).

    Decimal numbers are read as text and converted, so all digits and the whole range of
    doubles are kept. A field that is no number, and a malformed row, are errors.
    ``escaped`` undoes the writer's escapes of line breaks in text.
    """
    decimal = (T.DoubleType, T.FloatType, T.DecimalType)
    as_text = T.StructType([
        T.StructField(f.name, T.StringType(), True) if isinstance(f.dataType, decimal) else f for f in schema
    ])
    reader = spark.read.schema(as_text).options(header=True, sep=";", mode="FAILFAST", **QUOTING)
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)
        reader = reader.option("timestampNTZFormat", timestamp_format)
    rows = reader.csv(path)
    rows = _unescaped(rows) if escaped else rows

    def number(f: T.StructField):
        text = F.trim(f.name)
        plain = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        value = plain.try_cast(f.dataType)
        bad = F.raise_error(F.concat(F.lit(f"not a number in {f.name}: "), text)).cast(f.dataType)
        return F.when((text == "") | text.isNull() | value.isNotNull(), value).otherwise(bad).alias(f.name)

    return rows.select(*[number(f) if isinstance(f.dataType, decimal) else F.col(f.name) for f in schema])


def read_tsv(
    spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8", escaped: bool = False
) -> DataFrame:
    """Tab-separated text; a malformed row is an error. ``escaped`` as above."""
    reader = spark.read.schema(schema).options(header=True, sep="\t", encoding=encoding, mode="FAILFAST", **QUOTING)
    if encoding.upper().startswith("UTF-16"):
        # The line end must be given for an encoding that is not UTF-8.
        reader = reader.option("lineSep", "\n")
    rows = reader.csv(path)
    return _unescaped(rows) if escaped else rows


def read_codes(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A survey extract with raw answer codes."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def decode_labels(
    df: DataFrame, codebook: DataFrame, column: str, to: str | None = None
) -> DataFrame:
    """Replace the codes of one column by their labels.

    ``codebook`` has columns ``variable``, ``code`` and ``label``. An unlisted
    code gives NULL.
    """
    book = small_side(
        codebook.where(F.col("variable") == column)
        .select(F.col("code").alias("_code"), F.col("label").alias("_label"))
    )
    same = F.col(column).cast("string") == F.col("_code").cast("string")
    return df.join(book, same, "left").withColumn(to or column, F.col("_label")).drop("_code", "_label")


def decode_columns(df: DataFrame, codebook: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Observation]:
    """Replace the codes of many columns by their labels in one projection, without joins.

    ``codebook`` as in :func:`decode_labels`; a code listed twice for a column is an error.
    Unlisted codes give NULL, and the observation counts them per column in the pass that
    an action on the rows makes. Columns with more than ``CODES_SEARCHED`` codes, and all
    if the codebook has more than ``CODES_HELD``, are joined instead, with the same result.
    """
    kinds = dict(df.dtypes)
    book = codebook.where(F.col("variable").isin(list(columns))).select(
        "variable", F.col("code").cast("string").alias("code"), "label").where("code IS NOT NULL")
    again = book.groupBy("variable", "code").count().where("count > 1").first()
    if again:
        raise ValueError(f"code {again.code} is listed {again['count']} times for {again.variable}")
    sizes = {r.variable: r["count"] for r in book.groupBy("variable").count().collect()}  # one row a column
    held = [c for c in columns if 0 < sizes.get(c, 0) <= CODES_SEARCHED]
    if sum(sizes[c] for c in held) > CODES_HELD:
        held = []
    entries: dict[str, list] = {c: [] for c in held}
    for r in book.where(F.col("variable").isin(held)).collect() if held else []:  # at most CODES_HELD
        entries[r.variable] += [F.lit(r.code), F.lit(r.label)]
    out, unlisted = {}, []
    for c in columns:
        code = F.col(c) if kinds[c] == "string" else F.col(c).cast("string")
        if c in held:
            labels = F.create_map(*entries[c])
            out[c] = F.element_at(labels, code)
            unlisted.append(F.count_if(F.col(c).isNotNull() & ~F.map_contains_key(labels, code)).alias(c))
        elif not sizes.get(c):
            out[c] = F.lit(None).cast("string")
            unlisted.append(F.count(c).alias(c))
    joined = df
    for c in columns:
        if c not in out:
            side = small_side(book.where(F.col("variable") == c).select(F.col("code").alias(f"_code_{c}"), F.col("label").alias(f"_label_{c}")))
            joined = joined.join(side, F.col(c).cast("string") == F.col(f"_code_{c}"), "left")
            unlisted.append(F.count_if(F.col(c).isNotNull() & F.col(f"_code_{c}").isNull()).alias(c))
            out[c] = F.col(f"_label_{c}")
    seen = Observation("unlisted codes")
    return joined.observe(seen, *unlisted).select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns]), seen


DECISIONS = T.StructType([
    T.StructField("new", T.StringType()), T.StructField("old", T.StringType()),
    T.StructField("concordance", T.IntegerType()), T.StructField("comment", T.StringType()),
    T.StructField("comment2", T.StringType()), T.StructField("decision", T.StringType()),
])


def read_decisions(spark: SparkSession, path: str, escaped: bool = False) -> DataFrame:
    """The reviewed match decisions, exported as ``;`` CSV; a malformed row is an error."""
    rows = spark.read.schema(DECISIONS).options(header=True, sep=";", mode="FAILFAST", **QUOTING).csv(path)
    return _unescaped(rows) if escaped else rows


CANDIDATES = T.StructType([
    T.StructField("new", T.StringType()), T.StructField("old", T.StringType()), T.StructField("concordance", T.IntegerType()),
])


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate pairs as :func:`panelkit.sources.writers.write_candidates` leaves them."""
    return _unescaped(spark.read.schema(CANDIDATES).options(header=True, sep=";", mode="FAILFAST", **QUOTING).csv(path))


def read_review_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Factorised candidates as :func:`panelkit.sources.writers.write_review_lists` leaves them."""
    read = lambda name, schema: _unescaped(
        spark.read.schema(schema).options(header=True, sep=";", mode="FAILFAST", **QUOTING).csv(f"{path}/{name}"))
    return (read("lists", "new string, combo string, n long, before long, concordance int"),
            read("members", "combo string, old string, place long"))


def snapshot_read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
