"""Naive Bayes trained batch by batch: word counts per class in a table that grows by batches.

A batch adds its counts under its own id, in one pass over its documents and
one shuffle of per-task sums; the documents themselves are not needed again.
A batch that is added again -- a job that failed half-way, or a stream that
restarts -- replaces its own counts, so every batch counts once.  The model is
made from the sums of all batches: vocabulary, prior and parameters are those
of one fit over all documents.

The table is Parquet, partitioned by ``batch``.  Tasks write aside, and the job
moves a batch's folder into place at its end: a batch whose job fails before
leaves no counts, one that fails while moving is mended by adding it again.
Read it while no batch is being added.  Its size is that of the distinct words of
each batch and class, whatever the number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.operators.naive_bayes import nb_parameters
from revlens.operators.termstats import count_rows, explode_with_pos
from revlens.session import keep

SCHEMA = "label double, term string, n long, batch long"


@dataclass
class NBModel:
    """``vocab (term, idx, cf)``, ``prior (label, pi, theta0)``, ``theta (label, idx, theta)``."""

    vocab: DataFrame
    prior: DataFrame
    theta: DataFrame


def add_batch(docs: DataFrame, path: str, batch_id: int, words_col: str = "words", label_col: str = "label") -> None:
    """Add ``docs`` (label, words) to the statistics under ``path`` as batch ``batch_id``.

    Documents without a label are left out, as in training; NULL words count
    as none and NULL arrays as empty; a batch without documents adds nothing.
    """
    # a row with term NULL counts the class's documents: one per document, beside those of its words
    words = F.coalesce(F.filter(words_col, lambda t: t.isNotNull()), F.array().cast("array<string>"))
    rows = docs.where(F.col(label_col).isNotNull()).select(
        F.col(label_col).cast("double").alias("label"),
        F.concat(F.array(F.lit(None).cast("string")), words).alias("terms"))
    counts = explode_with_pos(rows, "terms", ["label"], "_pos", "term").groupBy("label", "term").agg(F.count(F.lit(1)).alias("n"))
    counts.withColumn("batch", F.lit(int(batch_id)).cast("long")).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """``label, term, n`` over all batches; ``term`` NULL counts the documents of the class."""
    return spark.read.schema(SCHEMA).parquet(path).groupBy("label", "term").agg(F.sum("n").alias("n"))


def nb_from_statistics(spark: SparkSession, path: str, vocab_size: int, smoothing: float = 1.0) -> NBModel:
    """The model of one fit over the documents of all batches: the top ``vocab_size`` words, ties by word."""
    stats = keep(statistics(spark, path))
    words = stats.where(F.col("term").isNotNull())
    order = [F.desc("cf"), F.asc("term")]
    top = words.groupBy("term").agg(F.sum("n").alias("cf")).orderBy(*order).limit(vocab_size)
    vocab = keep(top.select("term", (F.row_number().over(Window.orderBy(*order)) - 1).alias("idx"), "cf"))
    sums = words.join(F.broadcast(vocab.select("term", "idx")), "term").select("label", "idx", F.col("n").alias("n_ct"))
    classes = stats.where(F.col("term").isNull()).select("label", F.col("n").alias("n_c"))
    n_docs = classes.select(F.sum("n_c")).scalar()
    prior, theta = nb_parameters(classes, sums, n_docs, count_rows(vocab), smoothing)
    return NBModel(vocab, prior, theta)
