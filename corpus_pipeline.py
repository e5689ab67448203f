"""The corpus pipeline: toxic documents go, then exact copies, then near copies; secrets are masked, and what is left is packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import best_fit, exact_dedup, hyper_minhash, secrets, toxicity
from tidegauge.llm.shared import broadcast_if_small, free_name, new_path, written

#: SQL can't express the stages that need a model, shingle components or a tokenizer; tests hold them against brute force.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject, with all their columns.

    Null and empty texts are scored alike and stay, copies of a text share its fate, and an empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the smallest doc_id, of tied ids the one read first; null ids come last.

    Null texts are copies of empty ones. An empty table gives an empty one.
    """
    kept = free_name(docs.columns, "kept")  # the operator's own flag, not a column of docs
    return exact_dedup.exact_dedup(docs).filter(F.col(kept)).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, on 5-word shingles at 0.8: that with the smallest doc_id, of tied ids the one read first.

    Documents without words or text all stay. An empty table gives an empty one.
    """
    row = free_name(docs.columns, "_row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    gone = written(hyper_minhash.near_dedup(numbered, row_col=row).filter("not kept").select(F.col("row").alias(row)), "gone")
    return numbered.join(broadcast_if_small(gone, 2_000_000), row, "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts; n_chars follows, and is null where the text is. No row comes or goes."""
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences; null and empty texts are a piece of one token. An empty table gives no piece."""
    return best_fit.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("secrets", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again as the next one's input.

    Null texts count as empty: they aren't toxic, are copies of one another and of empty texts, hold no secrets and pack as one token. Texts without words
    are no near-duplicates; very long ones are read whole by every stage. Of tied and repeated rows the one read first stays. All stages but
    the last keep all columns, whatever their names and nulls; an empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
