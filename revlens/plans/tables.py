"""Models as versioned Parquet tables, joined with the data at scoring.

A saved model is a folder of versions.  Each version holds the parameters in
long form (naive Bayes: vocabulary, prior, theta; linear: coefficients), written by
the tasks that computed them, and becomes visible by its row in the
``manifest`` table, which is written last.  A save that fails half-way leaves
the versions before it as they were, and the next save takes its place.  One
writer at a time; readers any number.

Nothing of a model but its class prior and its few settings comes to the
driver, so vocabularies and coefficients may be larger than it: up to
``BROADCAST_ROWS`` rows they are broadcast at scoring, beyond that frequent
keys alone are, and the rest takes a sort-merge join.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.operators import termstats as ts
from revlens.operators.linear import linear_margin
from revlens.operators.naive_bayes import score_nb
from revlens.operators.skew import hot_cold_join, top_keys

MANIFEST = "kind string, settings string, tables array<string>, version int"
#: Rows of a vocabulary or coefficient table that may be broadcast.
BROADCAST_ROWS = 1_000_000


@dataclass
class TableModel:
    """``kind``, ``settings`` and the parameter ``tables`` of one version."""

    kind: str
    version: int
    settings: dict
    tables: dict[str, DataFrame]


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def save_tables(spark: SparkSession, path: str, kind: str, tables: dict[str, DataFrame], settings: dict) -> int:
    """Write the next version of the model under ``path``; returns its number (from 1)."""
    path = path.rstrip("/")
    known = _versions(spark, path)
    version = 1 + ((known.agg(F.max("version")).first()[0] or 0) if known is not None else 0)
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/v{version}/{name}")
    row = spark.createDataFrame([(kind, json.dumps(settings), sorted(tables), version)], MANIFEST)
    row.coalesce(1).write.mode("append").partitionBy("version").parquet(f"{path}/manifest")
    return version


def load_tables(spark: SparkSession, path: str, version: int | None = None) -> TableModel:
    """The given version, or the latest; ``ValueError`` where there is none."""
    path = path.rstrip("/")
    known = _versions(spark, path)
    if known is not None and version is not None:
        known = known.where(F.col("version") == version)
    row = known.orderBy(F.desc("version")).first() if known is not None else None
    if row is None:
        raise ValueError(f"no model {'version ' + str(version) if version is not None else ''} under {path}")
    tables = {name: spark.read.parquet(f"{path}/v{row['version']}/{name}") for name in row["tables"]}
    return TableModel(row["kind"], row["version"], json.loads(row["settings"]), tables)


def save_nb(spark: SparkSession, path: str, model, vocab_size: int) -> int:
    """Save anything with ``vocab``, ``prior`` and ``theta``; ``vocab_size`` bounds the vocabulary."""
    return save_tables(spark, path, "nb", {"vocab": model.vocab, "prior": model.prior, "theta": model.theta},
                       {"vocab_size": int(vocab_size)})


def score_nb_tables(model: TableModel, docs: DataFrame, words_col: str = "words",
                    broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` (doc_id, words, ...) without the words, plus ``prediction`` and ``score``."""
    _expect(model, "nb")
    vocab, size = model.tables["vocab"], model.settings["vocab_size"]
    if size <= broadcast_rows:
        feats = ts.vocabulary_counts(docs, words_col, vocab, ["doc_id"])
    else:
        tf = ts.term_frequency(docs, words_col)
        feats = hot_cold_join(tf, vocab.select("term", "idx"), "term", top_keys(vocab, "term", "cf")).select("doc_id", "idx", "tf")
    return score_nb(feats.withColumnRenamed("tf", "value"), docs.drop(words_col), model.tables["prior"], model.tables["theta"],
                    max_features=size if size <= broadcast_rows else None)


def save_linear(spark: SparkSession, path: str, coefficients: DataFrame, intercept: float, n_features: int,
                threshold: float = 0.0) -> int:
    """Save ``coefficients (idx, w)`` of a binary linear model; class 1 where the margin is above ``threshold``."""
    return save_tables(spark, path, "linear", {"coefficients": coefficients.select("idx", "w")},
                       {"intercept": float(intercept), "n_features": int(n_features), "threshold": float(threshold)})


def score_linear_tables(model: TableModel, features: DataFrame, docs: DataFrame, id_col: str = "doc_id",
                        broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` plus ``margin`` and ``prediction``, from ``features (id, idx, value)``; no features: the intercept."""
    _expect(model, "linear")
    weights, settings = model.tables["coefficients"], model.settings
    if settings["n_features"] <= broadcast_rows:
        out = linear_margin(features, weights, settings["intercept"], docs, id_col)
    else:
        counts = features.groupBy("idx").agg(F.count(F.lit(1)).alias("_n"))
        sums = hot_cold_join(features, weights, "idx", top_keys(counts, "idx", "_n")) \
            .groupBy(id_col).agg(F.sum(F.col("value") * F.col("w")).alias("_dot"))
        out = docs.join(sums, id_col, "left") \
            .withColumn("margin", F.coalesce("_dot", F.lit(0.0)) + F.lit(settings["intercept"])).drop("_dot")
    return out.withColumn("prediction", (F.col("margin") > F.lit(settings["threshold"])).cast("double"))


def _expect(model: TableModel, kind: str) -> None:
    if model.kind != kind:
        raise ValueError(f"a {model.kind!r} model, not {kind!r}")
