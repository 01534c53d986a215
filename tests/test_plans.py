"""Plan properties the scale design relies on."""

import os

import pytest
from pyspark.sql import functions as F

from revlens.operators import termstats as ts
from revlens.operators.prepare import prepare
from revlens.operators.skew import hot_cold_join, top_keys
from revlens.operators.stem import stem_tokens
from revlens.session import distribute
from revlens.sources.tables import read_table

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_null_filter_and_columns_reach_the_scan(spark):
    docs = read_table(spark, SF, "documents", ["doc_id", "text"])
    plan = _plan(prepare(docs, score_col=None, keep=["doc_id"]))
    pushed = plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "IsNotNull(text)" in pushed
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_distribute_leaves_split_inputs_alone(spark):
    many = spark.range(0, 1000, numPartitions=spark.sparkContext.defaultParallelism)
    assert distribute(many, "id") is many
    one = spark.range(0, 1000, numPartitions=1)
    assert distribute(one, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_token_explode_has_no_inferred_size_filter(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "doc_id long, words array<string>")
    plan = _plan(ts.token_stream(df, "words"))
    assert "size(" not in plan


def test_hot_cold_join_never_broadcasts_the_dimension(spark):
    fact = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("row"))
    dim = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = top_keys(fact.groupBy("k").count(), "k", "count", 2)
    plan = _plan(hot_cold_join(fact, dim, "k", hot))
    assert "SortMergeJoin" in plan


def _exchanges(df):
    return _plan(df).count("Exchange hashpartitioning")


def test_counts_take_one_exchange_on_unclustered_input(spark):
    """Arrays spread by nothing that has to do with the document id."""
    df = spark.range(1000, numPartitions=7).select(
        F.col("id").alias("doc_id"), F.array(F.lit("a"), (F.col("id") % 9).cast("string")).alias("words")).repartition(5)
    for counted in (ts.corpus_frequency(df, "words"), ts.document_frequency(df, "words")):
        assert _exchanges(counted) == 1
    vocab = ts.vocabulary(df, "words", 4)
    plan = _plan(ts.vocabulary_counts(df, "words", vocab, ["doc_id"]))
    # the vocabulary filter (a broadcast join) sits below the exchange of the counts
    assert plan.index("Exchange hashpartitioning(doc_id") < plan.index("BroadcastHashJoin")


def test_stemming_has_no_exchange(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.array(F.lit("running")).alias("words"))
    assert "Exchange" not in _plan(stem_tokens(df, "words", "stems"))


def test_vocabulary_join_is_broadcast(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"])], "doc_id long, words array<string>")
    tf = ts.term_frequency(df, "words")
    plan = _plan(ts.restrict_to_vocabulary(tf, ts.vocabulary(df, "words", 2)))
    assert "BroadcastHashJoin" in plan
