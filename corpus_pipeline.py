"""Corpus pipeline: language ID, near-duplicate removal, decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every result as Parquet under the cluster's shared folder and reads it back as
the next stage's documents.  All but the last return the columns of
``documents``; extra columns are carried along, whatever their names.  NULL and
empty texts are rejected by the first stage; the other stages keep them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.decontaminate import decontaminate
from revlens.llm.language_id import identify_documents
from revlens.llm.minhash import near_duplicates
from revlens.llm.packing import pack_documents
from revlens.llm.queries import tokenizer_file
from revlens.llm.secret_crf import redact
from revlens.llm.shuffle_tools import row_key, written
from revlens.sources.tables import read_table


#: What the language decision depends on; the other stages decide by id and text.
LANGUAGE_COLUMNS = ("doc_id", "text", "lang", "source")


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with the row key of ``columns`` as its doc_id: ids may be NULL or repeat with different texts."""
    return docs.withColumn("doc_id", row_key(*columns))


def _free_name(docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    name = "row_key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _keep(docs: DataFrame, kept: DataFrame, *columns: str, once: bool = False) -> DataFrame:
    """Rows of ``docs`` whose row key of ``columns`` is a doc_id of ``kept``; ``once``: one of those equal in ``columns``."""
    name = _free_name(docs)
    wanted = kept.select(F.col("doc_id").alias(name)).distinct()
    found = docs.withColumn(name, row_key(*columns)).join(wanted, name, "left_semi")
    # the key is still a column: rows dealt by it for the join need not be dealt again by id and text
    return (found.dropDuplicates([name, *columns]) if once else found).drop(name)


def _without(docs: DataFrame, dropped: DataFrame, *columns: str) -> DataFrame:
    """``docs`` without the rows whose row key of ``columns`` is a doc_id of ``dropped``.

    The keys are written first: where they are few, their known size lets Spark
    broadcast them, and no text is shuffled.
    """
    name = _free_name(docs)
    unwanted = written(dropped.select(F.col("doc_id").alias(name)).distinct(), "pipeline-dropped")
    return docs.join(unwanted, row_key(*columns) == F.col(name), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known well enough."""
    found = identify_documents(_keyed(docs, *LANGUAGE_COLUMNS)).withColumnRenamed("key", "doc_id")
    return _without(docs, found.where("NOT accepted"), *LANGUAGE_COLUMNS)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id: five-word shingles, similarity 0.8 or more."""
    found = written(near_duplicates(_keyed(docs, "doc_id", "text"), shingle_words=5, percent=80), "pipeline-dedup")
    ids = docs.select(row_key("doc_id", "text").alias("key"), F.col("doc_id").alias("id")).distinct()
    # in the order of ids, NULL last; rows that share the smallest id, by key
    place = F.struct(F.col("id").isNull().alias("none"), "id", F.col("key").alias("doc_id"))
    first = found.select(F.col("doc_id").alias("key"), "component_id").distinct().join(ids, "key") \
        .groupBy("component_id").agg(F.min(place).alias("first")).select("first.doc_id")
    return _keep(docs, first, "doc_id", "text", once=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item (13-word windows, one word in twenty)."""
    found = decontaminate(_keyed(docs, "doc_id", "text"), read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))
    return _without(docs, found.where("contaminated"), "doc_id", "text")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; ``n_chars`` follows the new text."""
    return redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"), drops_space=True, end_id=1)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", minhash_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", packing),
]

#: No SQL: the language model, the random field and the tokenizer are fitted or installed code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return docs
