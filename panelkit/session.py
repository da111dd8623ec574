"""Session settings, table loading and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


# A table is broadcast only after its values were found to take at most this.
BROADCAST_BYTES = 16 << 20
# And a set of fixed-width rows after its rows were counted.
BROADCAST_ROWS = 100_000


def ship(spark: SparkSession) -> None:
    """Send the package to the workers of a session, once, so that it need not be installed
    on each of them."""
    context = spark.sparkContext
    if getattr(context, "_panelkit_shipped", False):
        return
    root = Path(__file__).resolve().parent
    # Of the driver only: Spark's file server hands it to the executors.
    path = Path(tempfile.mkdtemp(prefix="panelkit-")) / "panelkit.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as file:
        for source in sorted(root.rglob("*.py")):
            file.write(source, f"panelkit/{source.relative_to(root)}")
    context.addPyFile(str(path))
    context._panelkit_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a running session, for as long as it
    lasts (time zone UTC, adaptive execution), and send it the package."""
    ship(spark)
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelkit")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    spark = prepare(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: the session's checkpoint folder.

    A machine-local folder is used only in local mode, where there is one
    machine; a cluster session without the setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="panelkit-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table written by a job."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and drop its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy per-row work on a table that may be read from few pieces."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def measured(df: DataFrame) -> int:
    """Bytes that the values of all rows take together; 0 only if there are none."""
    size = F.lit(8 * len(df.columns) + 8)
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, (StringType, BinaryType)):
            size += F.coalesce(F.octet_length(df[field.name]), F.lit(0))
        elif isinstance(kind, (ArrayType, MapType, StructType)):
            size += F.coalesce(F.octet_length(F.to_json(F.struct(df[field.name]))), F.lit(0))
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def fits(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> bool:
    return measured(df) <= most_bytes


def shuffled(df: DataFrame) -> DataFrame:
    """Mark a join side that grows with the input. Estimates of Spark do not count the rows
    of an explode and take Parquet's packed bytes, so it would broadcast millions of rows."""
    return df.hint("merge")


def small_side(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise a join side and mark it for broadcast if it is small.

    A larger table is returned without the hint, so Spark shuffles it.
    """
    df = cut(df)
    return df.hint("broadcast") if fits(df, most_bytes) else df
