"""Delimited text whose quoted fields may hold line breaks, read in pieces.

Spark reads such files only whole, one file a task. Here lines are read from any number of
pieces of a file, and quotes decide which lines belong together:

1. A piece is described by the parity of its quotes; a running sum over the pieces of a file
   tells whether a piece begins inside a quoted field.
2. Pieces that begin outside and in which every line has an even number of quotes hold only
   whole records, and their lines go on without a shuffle. In the others a running sum of
   quotes marks the lines at which a record begins, and the lines of a record are joined.
3. Each record is parsed by ``from_csv``; those that do not fit the schema go to a table of
   their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, small_side

REJECT = "_rejected"


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """file, piece, place (rising inside a piece), line (without its line feed), odd."""
    wide = encoding.upper().startswith("UTF-16")
    reader = spark.read.options(lineSep="\n", **({"encoding": encoding} if wide else {}))
    line = F.decode(F.col("value").cast("binary"), encoding) if encoding.upper() != "UTF-8" else F.col("value")
    rows = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"),
        F.monotonically_increasing_id().alias("place"), line.alias("line"))
    return rows.withColumn("odd", (F.length(F.regexp_replace("line", '[^"]', "")) % 2).cast("int"))


def _pieces(lines: DataFrame) -> DataFrame:
    """file, piece, opens (whether it begins inside a quoted field), plain, and the place of
    the first line of the file."""
    own = lines.groupBy("file", "piece").agg(
        F.sum("odd").alias("quotes"), F.max("odd").alias("any_odd"), F.min("place").alias("least"))
    # One row a piece: windows over the pieces of one file.
    order = Window.partitionBy("file").orderBy("piece")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    return own.select("file", "piece", (opens == 1).alias("opens"), ((opens == 0) & (F.col("any_odd") == 0)).alias("plain"),
                      F.first("least").over(order).alias("head"))


def records(spark: SparkSession, path: str, encoding: str = "UTF-8", header: bool = True, most_bytes: int = 64 << 20) -> DataFrame:
    """record (its text, line breaks inside quotes kept) and size of every record of the files.

    ``size`` is in bytes, without the line end. A record longer than ``most_bytes`` (a quote that is never closed makes one of the rest
    of its file) keeps its size and place, but its text is NULL. Lines end in LF or CR LF.
    Empty lines outside quotes are no records. ``header`` leaves out the first record of
    each file.
    """
    lines = _lines(spark, path, encoding)
    pieces = small_side(_pieces(lines).select(F.col("file").alias("_file"), F.col("piece").alias("_piece"), "opens", "plain", "head"))
    marked = lines.join(pieces, (F.col("file") == F.col("_file")) & (F.col("piece") == F.col("_piece")), "left").drop("_file", "_piece")
    # A second reading that cuts files elsewhere must not go unseen.
    marked = marked.withColumn("plain", F.coalesce("plain", F.raise_error(F.lit("files were cut into other pieces")).cast("boolean")))

    kept = F.col("place") != F.col("head") if header else F.lit(True)
    whole = marked.where("plain").where(kept).select("file", "place", "line", F.octet_length("line").cast("long").alias("size"))

    inside = Window.partitionBy("file", "piece").orderBy("place")
    begins = (F.coalesce(F.sum("odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("opens").cast("int")) % 2 == 0
    parts = cut(marked.where("not plain").withColumn("start", F.when(begins, F.col("place"))))
    parts = parts.withColumn("own", F.last("start", True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # Lines before the first start of a piece belong to the last start before that piece. A
    # plain piece cannot lie between: it begins outside of quotes.
    latest = parts.groupBy("file", "piece").agg(F.max("start").alias("latest"))
    order = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select(F.col("file").alias("_file"), F.col("piece").alias("_piece"), F.last("latest", True).over(order).alias("carried"))
    owned = parts.join(carried, (F.col("file") == F.col("_file")) & (F.col("piece") == F.col("_piece"))).withColumn(
        "own", F.coalesce("own", "carried")).where(F.col("own") != F.col("head") if header else F.lit(True))
    # Sizes first, so that the lines of an endless record never meet in one task.
    sizes = owned.groupBy("file", "own").agg((F.sum(F.octet_length("line") + 1) - 1).alias("size"))
    long = sizes.where(F.col("size") > most_bytes).select("file", F.col("own").alias("place"), F.lit(None).cast("string").alias("line"), "size")
    single = owned.join(sizes.where(F.col("size") <= most_bytes), ["file", "own"])
    joined = single.groupBy("file", F.col("own").alias("place")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "place", "line"))), lambda x: x["line"]), "\n").alias("line"),
        F.max("size").cast("long").alias("size"))
    every = whole.unionByName(joined).unionByName(long)
    # A byte order mark stands before the first field, the CR of a line end behind the last.
    text = F.regexp_replace(F.regexp_replace("line", "^\\uFEFF", ""), "\r$", "")
    return every.withColumn("record", text).where("record IS NULL OR record <> ''").select("file", "place", "record", "size")


def read_quoted(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ";", encoding: str = "UTF-8",
    decimal_comma: bool = False, header: bool = True, most_bytes: int = 64 << 20,
) -> tuple[DataFrame, DataFrame]:
    """The rows of delimited text with doubled quotes, and the rejected records.

    A record is rejected if it has another number of fields than the schema, a value
    that is not of its type, or more than ``most_bytes``. The rejected table has file,
    record (NULL if too long) and size. Empty fields are NULL, quoted or not.
    """
    decimals = (T.DoubleType, T.FloatType, T.DecimalType)
    as_text = T.StructType([
        T.StructField(f.name, T.StringType() if decimal_comma and isinstance(f.dataType, decimals) else f.dataType) for f in schema
    ] + [T.StructField(REJECT, T.StringType())])
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT,
               "maxCharsPerColumn": "-1", "maxColumns": str(max(20_480, len(schema) + 1)), "emptyValue": "", "lineSep": "\n"}
    parsed = records(spark, path, encoding, header, most_bytes).withColumn("row", F.from_csv("record", as_text.toDDL(), options))

    def value(f: T.StructField):
        own = F.col("row").getField(f.name)
        if decimal_comma and isinstance(f.dataType, decimals):
            return F.replace(F.replace(F.trim(own), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast(f.dataType)
        return F.nullif(own, F.lit("")) if isinstance(f.dataType, T.StringType) else own

    bad = F.col("record").isNull() | F.col("row").getField(REJECT).isNotNull()
    for f in schema:
        if decimal_comma and isinstance(f.dataType, decimals):
            raw = F.trim(F.col("row").getField(f.name))
            bad |= F.coalesce(raw != "", F.lit(False)) & value(f).isNull()
    rows = parsed.where(~bad).select(*[value(f).alias(f.name) for f in schema])
    return rows, parsed.where(bad).select("file", "record", "size")
