"""Exact dedup against a persistent digest index.

The index is a table of one row per distinct text -- SHA-256 digest, the id
and place of the row that stays, its generation -- bucketed and sorted by
digest.  New data is reduced to one row per digest (partial sums first, so a
text that a third of all rows share costs one row per task), shuffled once to
the index's buckets, stripped of known digests by a sort-merge anti-join that
reads the index without a shuffle, and appended as one sorted file per bucket.
Rows that were there before never change, so a repeated ``add`` of the same
rows adds nothing.

The index lives under a path of the caller (shared storage); ``open_index``
registers the files with the session's catalog, so it outlives sessions.

Defined results: texts are compared after every run of ``[\\x20\\x09-\\x0D]`` has
become one space; NULL counts as empty.  Of equal texts the smallest doc_id of
the first generation that has the text stays, NULL after all others; of rows
that repeat that id exactly one is ``kept``.  Equality is equality of SHA-256
digests.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.shuffle_tools import join_weighted, written

SCHEMA = "digest binary, keep_id long, keep_batch string, keep_place long, generation int"


def normalised(text: Column) -> Column:
    """NULL as empty, every run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def digested(docs: DataFrame) -> DataFrame:
    """``batch, place, doc_id, digest`` of every row, written: batch and place tell rows with one id apart."""
    digest = F.unhex(F.sha2(normalised(F.col("text")), 256))
    return written(docs.select(F.lit(uuid.uuid4().hex).alias("batch"), F.monotonically_increasing_id().alias("place"),
                               "doc_id", digest.alias("digest")), "dedup-digests")


def _first_rows(digests: DataFrame) -> DataFrame:
    """One row per digest: the row that would stay, and the number of rows."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "batch", "place")
    return digests.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("group_size")) \
        .select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.batch").alias("keep_batch"),
                F.col("first.place").alias("keep_place"), "group_size")


@dataclass
class DigestIndex:
    """A digest index open in one session."""

    spark: SparkSession
    table: str
    path: str
    buckets: int

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def generations(self) -> int:
        return (self.rows().agg(F.max("generation")).first()[0] or 0)

    def add(self, digests: DataFrame) -> None:
        """Append the digests of ``digests`` (of ``digested``) that the index does not hold, as one generation."""
        new = _first_rows(digests).drop("group_size") \
            .join(self.rows().select("digest").hint("merge"), "digest", "left_anti") \
            .withColumn("generation", F.lit(self.generations() + 1))
        self._append(new.repartition(self.buckets, "digest"))

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest") \
            .option("path", self.path).option("compression", "zstd").saveAsTable(self.table)

    def report(self, digests: DataFrame) -> DataFrame:
        """Every row of ``digests``: doc_id, digest, keep_id, group_size (rows of ``digests``), kept.

        A digest that a large share of the rows has is joined by broadcast (at
        most 1 / HOT_SHARE digests), so its rows stay where they are.
        """
        sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
        known = written(sizes.join(self.rows().hint("merge"), "digest"), "dedup-known")
        return join_weighted(digests, known, ["digest"], "group_size", "inner").select(
            "doc_id", "digest", "keep_id", "group_size",
            ((F.col("place") == F.col("keep_place")) & (F.col("batch") == F.col("keep_batch"))).alias("kept"))

    def close(self) -> None:
        """Forget the table; its files stay and can be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def open_index(spark: SparkSession, path: str, buckets: int | None = None) -> DigestIndex:
    """The index at ``path``, made there if there is none.

    ``buckets`` (default: the session's shuffle partitions) is fixed when an
    index is made and must be given again when it is opened.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"digest_index_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE TABLE {name} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
              f"LOCATION '{path}'")
    return DigestIndex(spark, name, path, buckets)


def deduplicate(docs: DataFrame, path: str, parts: int = 2) -> DataFrame:
    """All ``docs`` through a new index at ``path`` in ``parts`` batches of ascending doc_id.

    The batches are ranges of equal width between the smallest and the largest
    id (NULL ids come last), so the first batch with a text holds its smallest id.
    """
    digests = digested(docs)
    index = open_index(docs.sparkSession, path)
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    cuts = sorted({low + (high - low) * i // parts + 1 for i in range(1, parts)}) if low is not None else []
    for lower, upper in zip([None, *cuts], [*cuts, None]):
        inside = F.lit(True) if lower is None else F.col("doc_id").isNull() | (F.col("doc_id") >= lower)
        if upper is not None:
            inside = inside & (F.col("doc_id") < upper)
        index.add(digests.where(inside))
    return index.report(digests)
