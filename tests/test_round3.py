"""Queries and helpers whose cost must follow the input, on rows of their own."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revlens.functions.porter2 import stem
from revlens.operators import stem as stems
from revlens.operators import termstats as ts
from revlens.plans.ml_catalog import ML_QUERIES
from revlens.sources import splits


@pytest.fixture
def sf(spark, tmp_path):
    texts = ["Running dogs, running cats", "", None, "cats", "running " * 40, "a\nb \"quoted\", and generally more"]
    rows = [(i, texts[i % 6]) for i in range(30)] + [(3, "other words"), (3, "cats"), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "sf/documents.parquet"))
    return str(tmp_path / "sf")


@pytest.mark.parametrize("size", [1, 2, 100])
def test_stems_stay_in_arrow(monkeypatch, size):
    monkeypatch.setattr(stems, "SLICE_ROWS", size)
    rows = [["running", "dogs", None], None, [], ["a", "running"], [None]] * 3
    arrays = pa.array(rows, pa.list_(pa.string()))
    want = [None if r is None else [None if t is None else stem(t) for t in r] for r in rows]
    got = stems.stem_arrays.func(arrays)
    assert isinstance(got, pa.Array) and got.to_pylist() == want
    assert stems.stem_arrays.func(arrays.slice(2, 6)).to_pylist() == want[2:8]
    assert stems.stem_arrays.func(arrays.slice(0, 0)).to_pylist() == []


def test_stem_consistency_searches_no_arrays(spark, sf, monkeypatch):
    df = ML_QUERIES["stem_consistency"](spark, sf)
    assert {tuple(r) for r in df.collect()} == {("same_stems", True), ("same_lengths", True)}
    assert "array_position" not in df._jdf.queryExecution().optimizedPlan().toString()
    # a stem at the wrong place is still found
    from revlens.plans import ml_catalog
    right = ml_catalog.stem_tokens
    monkeypatch.setattr(ml_catalog, "stem_tokens", lambda d, c, o: right(d, c, o) if o != "stems" else d.withColumn(o, F.reverse(c)))
    assert ("same_stems", False) in {tuple(r) for r in ML_QUERIES["stem_consistency"](spark, sf).collect()}


def test_hashing_rows(spark, sf):
    df = ML_QUERIES["hashing_tf_rows"](spark, sf)
    got = {(r.doc_id, r.mass, r.same) for r in df.collect()}
    assert (0, 4.0, True) in got and (1, 1.0, True) in got and (4, 40.0, True) in got
    assert (None, 0.0, True) in got            # an id that joins with nothing
    assert (3, 3.0, False) in got              # "cats" twice and other words under one id
    assert "FullOuter" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_small_splits_share_tasks(spark, tmp_path):
    spark.range(0, 60_000, 1, 1).select(F.concat(F.lit("line "), "id")).write.text(str(tmp_path / "lines"))
    other = spark.newSession()
    other.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    other.conf.set("spark.sql.files.openCostInBytes", "0")
    lines = splits.scanned_lines(other, str(tmp_path / "lines"))
    assert lines.select("block").distinct().count() > 100
    assert lines.rdd.getNumPartitions() <= splits.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    got = splits.read_numbered_lines(other, str(tmp_path / "lines")).collect()
    assert sorted((r.id, r.line) for r in got) == [(i, f"line {i}") for i in range(60_000)]


def test_weights_are_counted_once(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, [])], "doc_id long, words array<string>")
    out = ts.tfidf(ts.term_frequency(docs, "words"), ts.idf_weights(docs, "words", F.lit(3)), hot_keys=1)
    assert {(r.doc_id, r.term, r.tf, round(r.idf, 6)) for r in out.collect()} == {
        (1, "a", 2, 0.287682), (1, "b", 1, 0.693147), (2, "a", 1, 0.287682)}
    assert "array_distinct" not in out._jdf.queryExecution().optimizedPlan().toString()
