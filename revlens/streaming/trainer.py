"""Structured Streaming trainer: naive Bayes statistics from files as they arrive.

Each micro-batch adds the word counts of its train-split documents under the
stream's own batch id.  After a restart the stream repeats the batch that was
under way with the same id and the same files, and its counts replace
themselves, so each document counts once.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.operators.incremental import add_batch
from revlens.plans.relational import labelled_words


def train_files(spark: SparkSession, source_dir: str, schema: T.StructType | str, stats_path: str, checkpoint: str,
                max_files_per_trigger: int | None = None) -> str:
    """Add every labelled file (doc_id, text, label) under ``source_dir`` to the statistics; return their path."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def add(batch, batch_id):
        words = labelled_words(batch).where(F.col("split") == "train")
        add_batch(words.select("label", "words"), stats_path, batch_id)
    query = (reader.parquet(source_dir).writeStream.foreachBatch(add)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return stats_path
