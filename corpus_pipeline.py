"""The corpus pipeline: toxic texts out, one of near copies, surrogates, mix, piece ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns
the columns of ``documents``; the last returns one digest of piece ids per row. Stages are
written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import jaccard, mixing, pieces, surrogates, toxicity
from panelkit.llm.queries import tokenizer_path
from panelkit.session import load, prepare, scratch_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_rows(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The stage's own threshold; op5's contract (4 words, 0.85) binds that query only.
    return jaccard.one_of_each(docs, k=5, percent=80)


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    new = surrogates.pseudonymise(docs).select(*docs.columns)
    return new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digest_frame(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("jaccard_join", without_near_copies),
    ("surrogates", with_surrogates),
    ("mixing", mixed),
    ("piece_encoding", encoded),
]
# Learned scores and keyed hashes of texts have no SQL form; tests compare the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(prepare(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
