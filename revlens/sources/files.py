"""File sources and sinks: quoted CSV, line text, prediction output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.sources.splits import FILE_IDS, read_records

# The CSV dialect of the reference's review files (header row,
# double-quoted fields, doubled quotes inside, newlines inside fields).
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}

# Column names of the reference's review files.
REVIEW_COLUMNS = {"score": "review/score", "text": "review/text"}
OWN_COLUMNS = {"doc_id": "doc_id", "score": "score", "text": "text"}


def write_reviews_csv(df: DataFrame, path: str) -> None:
    """Write reviews as quoted CSV that ``read_reviews_csv`` reads back unchanged."""
    (df.write.mode("overwrite")
     .options(**CSV_OPTIONS)
     .option("quoteAll", "true")
     .option("ignoreLeadingWhiteSpace", "false")
     .option("ignoreTrailingWhiteSpace", "false")
     .csv(path))


def read_reviews_csv(spark: SparkSession, path: str, columns: dict[str, str] = OWN_COLUMNS,
                     partitions: int | None = None) -> DataFrame:
    """``doc_id, score, text`` of quoted CSV files with newlines in fields, taken by column name.

    ``columns`` names the file's column of each; other columns are ignored and
    a missing one raises.  Without a ``doc_id`` column the id is made from the
    file's and the record's place (``splits``), so it does not depend on how
    the files are scanned.  Types are not inferred: a score that is no number
    becomes NULL.  Large files are read by many tasks; ``partitions`` spreads
    the rows of small ones before the heavy text work.
    """
    names = spark.read.options(**CSV_OPTIONS).csv(path).columns
    missing = [c for c in columns.values() if c not in names]
    if missing:
        raise ValueError(f"no column {missing} in {path} (has {names})")
    records = read_records(spark, path).where((F.col("id") % FILE_IDS != 0) & (F.col("record") != ""))
    fields = F.from_csv("record", ", ".join(f"f{i} string" for i in range(len(names))), {"quote": '"', "escape": '"'})
    field = {k: F.col(f"r.f{names.index(v)}") for k, v in columns.items()}
    doc_id = field["doc_id"].try_cast("long") if "doc_id" in field else F.col("id")
    df = records.select("id", fields.alias("r")).select(
        doc_id.alias("doc_id"), field["score"].try_cast("double").alias("score"), field["text"].alias("text"))
    return df.repartition(partitions) if partitions else df


def labelled_reviews(spark: SparkSession, path: str, columns: dict[str, str] = REVIEW_COLUMNS,
                     partitions: int | None = None) -> DataFrame:
    """``doc_id, text, label`` for training from review CSV files: ratings 1..3 are
    class 0, 4..5 class 1; rows without a text or with any other rating go."""
    from revlens.operators.prepare import binarize, drop_null_reviews, split_valid_scores
    rated, _ = split_valid_scores(read_reviews_csv(spark, path, columns, partitions))
    return binarize(drop_null_reviews(rated, ["text"]), "score", "label").select("doc_id", "text", "label")


def read_lines(spark: SparkSession, path: str, text_col: str = "text") -> DataFrame:
    """One row per line of the text files under ``path`` (splittable scan)."""
    return spark.read.text(path).withColumnRenamed("value", text_col)


def with_line_ids(df: DataFrame, id_col: str = "line_id") -> DataFrame:
    """Attach a unique id per row without a shuffle or a single-partition window.

    The id depends on the scan; ``read_numbered_lines`` gives ids that do not.
    """
    return df.withColumn(id_col, F.monotonically_increasing_id())


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Distributed prediction sink (no collect to the driver)."""
    df.write.mode("overwrite").format(fmt).save(path)
