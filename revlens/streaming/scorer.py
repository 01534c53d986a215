"""Structured Streaming scorer: the batch scoring job applied to files as
they arrive.

New review files are picked up by a file source, every micro-batch goes
through the fitted pipeline (preparation, features, classifier; no state is
kept between batches) and predictions are appended to a Parquet sink.  Word
vectors are a table, which batches are joined with one by one: their sink has a
folder for each, ``batch=<n>``, which a repeated batch replaces.  The caller names the checkpoint folder (shared storage): a
query restarted with it resumes where it stopped and each file is scored once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.plans.pipelines import FittedPipeline, prediction_col


def stream_predictions(stream: DataFrame, fitted: FittedPipeline, classifier: str,
                       id_cols: list[str]) -> DataFrame:
    """Streaming DataFrame of ``(ids..., prediction)``."""
    if classifier not in fitted.classifiers:
        raise ValueError(f"model has no {classifier!r} classifier")
    return fitted.transform(stream).select(*id_cols, F.col(prediction_col(classifier)).alias("prediction"))


def score_files(spark: SparkSession, source_dir: str, schema: T.StructType, fitted: FittedPipeline,
                classifier: str, id_cols: list[str], sink_path: str, checkpoint: str,
                file_glob: str | None = None, max_files_per_trigger: int | None = None) -> str:
    """Score every file present under ``source_dir`` (``availableNow``) and return the sink path.

    All files go into one micro-batch unless ``max_files_per_trigger`` is given.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    stream = reader.parquet(source_dir)
    if fitted.vectors is not None:
        if classifier not in fitted.classifiers:
            raise ValueError(f"model has no {classifier!r} classifier")

        def write(batch: DataFrame, n: int) -> None:
            stream_predictions(batch, fitted, classifier, id_cols).write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch={n}")
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint) \
            .trigger(availableNow=True).start().awaitTermination()
        return sink_path
    query = (stream_predictions(stream, fitted, classifier, id_cols)
             .writeStream.format("parquet").outputMode("append")
             .option("path", sink_path).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return sink_path
