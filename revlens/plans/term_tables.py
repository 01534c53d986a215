"""Term statistics stored by term, so that later jobs join them without moving the corpus.

The counts ``(doc_id, term, tf)`` are written once, bucketed and sorted by
``(term, salt)``.  Tables keyed by term (document frequencies, theta,
coefficients) are stored the same way, so a join of the two reads matching
buckets side by side and has no Exchange.

A term that holds more than one bucket's share of the rows would make its
bucket hot.  Its rows are dealt over ``salts = ceil(rows * buckets / all
rows)`` salts by document, and its rows in the other tables are repeated that
often.  Fewer than ``buckets`` terms can be that frequent and their salts sum
to less than twice the buckets, so both the broadcast list of them and what
the repeats add stay below a bound known beforehand.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from revlens.operators import termstats as ts

SETTINGS = "name string, schema string, buckets int, n_docs long"
#: Name of the counts, and of the document frequencies stored beside them.
COUNTS, FREQUENCIES = "tf", "df"


@dataclass
class TermTables:
    """Tables by term under ``path``, open in one session."""

    spark: SparkSession
    path: str
    buckets: int
    n_docs: int
    tables: dict[str, str]   # name -> table of the session's catalog

    def add(self, name: str, table: DataFrame) -> None:
        """Store ``table`` (a ``term`` column and others, any number of rows a term) beside the counts."""
        if name in self.tables:
            raise ValueError(f"{name!r} is stored already")
        if "salt" in table.columns:
            raise ValueError("'salt' is a column of the stored tables")
        salts = F.coalesce(F.col("salts"), F.lit(1))
        repeated = table.join(F.broadcast(self._hot()), "term", "left") \
            .withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        self._store(name, repeated)

    def join(self, name: str, how: str = "inner") -> DataFrame:
        """The counts with the columns of table ``name``, joined bucket by bucket."""
        return self.joined(self.spark.table(self.tables[name]), how)

    def joined(self, table: DataFrame, how: str = "inner") -> DataFrame:
        """The counts joined with ``table``: a stored table, or columns made of it with ``term`` and ``salt`` kept."""
        # without the hint Spark would broadcast a table that is small on disk, whatever it is in memory
        return self.spark.table(self.tables[COUNTS]).join(table.hint("merge"), ["term", "salt"], how).drop("salt")

    def tfidf(self, min_doc_freq: int = 0) -> DataFrame:
        """``term, doc_id, tf, df, idf, tfidf`` of all counts."""
        weights = ts.with_idf(self.spark.table(self.tables[FREQUENCIES]), F.lit(self.n_docs), min_doc_freq)
        return self.joined(weights).withColumn("tfidf", F.col("tf") * F.col("idf"))

    def close(self) -> None:
        """Forget the tables; their files stay and can be opened again."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def _hot(self) -> DataFrame:
        return self.spark.read.schema("term string, salts int").parquet(f"{self.path}/hot")

    def _store(self, name: str, rows: DataFrame) -> None:
        table = _table_name(name)
        (rows.repartition(self.buckets, "term", "salt").write.bucketBy(self.buckets, "term", "salt").sortBy("term", "salt")
         .option("path", f"{self.path}/{name}").saveAsTable(table))
        # the row that makes the table known comes last
        row = [(name, rows.schema.json(), self.buckets, self.n_docs)]
        self.spark.createDataFrame(row, SETTINGS).coalesce(1).write.mode("append").parquet(f"{self.path}/settings")
        self.tables[name] = table


def _table_name(name: str) -> str:
    return f"term_{name}_{uuid.uuid4().hex[:12]}"


def _salt(id_col: str) -> Column:
    return F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(id_col), F.col("salts")).cast("int"))


def store_terms(docs: DataFrame, words_col: str, path: str, buckets: int | None = None, id_col: str = "doc_id") -> TermTables:
    """Count the words of ``docs`` and store the counts and document frequencies under ``path`` (a new folder).

    ``buckets`` defaults to the session's shuffle partitions.  Documents
    without words count for the idf and have no rows.  The words are read
    twice (frequencies, then counts); the counts are dealt by term once.
    """
    spark = docs.sparkSession
    path, buckets = path.rstrip("/"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ts.document_frequency(docs, words_col).write.parquet(f"{path}/frequencies")
    freq = spark.read.parquet(f"{path}/frequencies")
    rows = freq.agg(F.sum("df")).scalar()
    share = F.ceil(F.col("df") * buckets / rows).cast("int")
    freq.where(F.col("df") * buckets > rows).select("term", share.alias("salts")).write.parquet(f"{path}/hot")
    out = TermTables(spark, path, buckets, docs.count(), {})
    counts = ts.term_frequency(docs, words_col, id_col).join(F.broadcast(out._hot()), "term", "left")
    out._store(COUNTS, counts.withColumn("salt", _salt(id_col)).drop("salts"))
    out.add(FREQUENCIES, freq)
    return out


def open_terms(spark: SparkSession, path: str) -> TermTables:
    """The tables stored under ``path``."""
    path = path.rstrip("/")
    known = spark.read.schema(SETTINGS).parquet(f"{path}/settings").collect()   # one row a table
    out = TermTables(spark, path, known[0]["buckets"], known[0]["n_docs"], {})
    for row in known:
        table = _table_name(row["name"])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(row["schema"])))
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (term, salt) SORTED BY (term, salt) "
                  f"INTO {row['buckets']} BUCKETS LOCATION '{path}/{row['name']}'")
        out.tables[row["name"]] = table
    return out
