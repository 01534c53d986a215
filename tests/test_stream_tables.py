"""The streaming scorer over tables that are a folder of files."""

from pyspark.sql import functions as F

from revlens.plans.ml_catalog import ML_QUERIES


def test_stream_score_of_a_folder(spark, tmp_path):
    sf = str(tmp_path / "sf")
    texts = spark.range(120).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "good fine film").otherwise("bad dull film").alias("text"))
    texts.write.parquet(f"{sf}/documents.parquet")
    texts.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality")).write.parquet(f"{sf}/labels.parquet")
    turns = texts.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), "text")
    turns.repartition(3).write.parquet(f"{sf}/conversations.parquet")
    got = {tuple(r) for r in ML_QUERIES["stream_score"](spark, sf).collect()}
    assert got == {("same_as_batch", True), ("all_rows_scored", True)}
