"""Parquet tables and the derived review relations every job starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.text import hash_bucket
from revlens.session import distribute


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """Read one parquet table; selecting ``columns`` right at the scan keeps
    the ReadSchema minimal (column pruning reaches the file reader)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """``documents`` spread by ``doc_id`` when the scan is too coarse for the cluster."""
    return distribute(read_table(spark, sf_dir, "documents", columns or ["doc_id", "text"]), "doc_id")


def labelled_documents(spark: SparkSession, sf_dir: str, target: str = "quality") -> DataFrame:
    """``documents`` joined with ``labels``: ``doc_id, text, label`` (label as double);
    rows without a label or a text are dropped, as the reference's dropna() does.

    Both sides grow with the data and ``doc_id`` is unique on each, so the join is
    left to Spark: AQE turns it into a broadcast join only when the runtime size
    of ``labels`` is under the broadcast threshold, else it stays a sort-merge join.
    """
    docs = distribute(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id")
    labels = read_table(spark, sf_dir, "labels", ["doc_id", target])
    return (docs.join(labels, "doc_id")
            .where(F.col(target).isNotNull() & F.col("text").isNotNull())
            .select("doc_id", "text", F.col(target).cast("double").alias("label")))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for the reference's review CSV: ``doc_id, score, text``.

    Every document is a review with a star rating 1..5 (from the id hash).
    """
    docs = distribute(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id")
    return docs.select("doc_id", (F.pmod(hash_bucket("doc_id"), F.lit(5)) + 1).cast("double").alias("score"), "text")


def reviews_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reviews`` in which some ratings (every 17th id) and some texts (every 19th id) are NULL."""
    return reviews(spark, sf_dir).select(
        "doc_id", F.when(F.col("doc_id") % 17 != 0, F.col("score")).alias("score"),
        F.when(F.col("doc_id") % 19 != 0, F.col("text")).alias("text"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for a sentiment head's output: ``event_id, sentiment
    array<struct<result:string>>`` built from ``events.event_type``
    (purchase/signup -> pos, error -> neg, click -> neutral, view -> no annotation)."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type"])
    result = (F.when(F.col("event_type").isin("purchase", "signup"), F.lit("pos"))
              .when(F.col("event_type") == "error", F.lit("neg"))
              .otherwise(F.lit("neutral")))
    empty = F.array().cast("array<struct<result:string>>")
    return ev.select(
        "event_id",
        F.when(F.col("event_type") == "view", empty)
        .otherwise(F.array(F.struct(result.alias("result")))).alias("sentiment"),
    )
