"""Batch-wise naive Bayes statistics against one fit, and metrics taken while writing."""

import pytest
from pyspark.sql import functions as F

from revlens.operators.evaluate import metrics_report
from revlens.operators.incremental import add_batch, nb_from_statistics, statistics
from revlens.operators.observed import write_with_metrics
from revlens.plans.relational import count_vector_nb
from revlens.streaming import train_files


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [(i, float(i % 3 == 0), "train", [f"w{(i * j) % 17}" for j in range(i % 9)] + ["hot"] * (i % 4)) for i in range(300)]
    return spark.createDataFrame(docs + [(900, 1.0, "train", [])], "doc_id long, label double, split string, words array<string>").cache()


def test_batches_equal_one_fit(spark, corpus, tmp_path):
    path = str(tmp_path / "stats")
    for b in range(3):
        add_batch(corpus.where(F.col("doc_id") % 3 == b), path, b)
    before = rows(statistics(spark, path))
    add_batch(corpus.where(F.col("doc_id") % 3 == 1), path, 1)  # repeated: replaces itself
    add_batch(corpus.limit(0), path, 7)
    add_batch(corpus.limit(0), path, 1)  # nothing to add, nothing to replace
    assert rows(statistics(spark, path)) == before
    got, want = nb_from_statistics(spark, path, 10), count_vector_nb(corpus, 10)
    for part in ("vocab", "prior", "theta"):
        a, b = getattr(got, part), getattr(want, part)
        assert rows(a) == rows(b.select(a.columns))


def test_odd_documents(spark, tmp_path):
    path = str(tmp_path / "stats")
    docs = [(1.0, ["a", None, "a"]), (1.0, None), (0.0, []), (None, ["a"])]
    add_batch(spark.createDataFrame(docs, "label double, words array<string>"), path, 0)
    assert rows(statistics(spark, path)) == sorted([(1.0, None, 2), (1.0, "a", 2), (0.0, None, 1)], key=repr)


def test_stream_restarts(spark, tmp_path):
    """Files that arrive later add to the statistics; a second start adds none twice."""
    src, stats, ckpt = (str(tmp_path / n) for n in ("in", "stats", "ckpt"))
    docs = spark.createDataFrame([(i, f"word{i % 5} good film", float(i % 2)) for i in range(200)], "doc_id long, text string, label double")
    docs.where("doc_id < 120").repartition(3).write.parquet(src)
    train_files(spark, src, docs.schema, stats, ckpt, 1)
    train_files(spark, src, docs.schema, stats, ckpt, 1)
    docs.where("doc_id >= 120").write.mode("append").parquet(src)
    train_files(spark, src, docs.schema, stats, ckpt, 1)
    whole = str(tmp_path / "whole")
    train_files(spark, src, docs.schema, whole, str(tmp_path / "ckpt2"))
    assert rows(statistics(spark, stats)) == rows(statistics(spark, whole))


def test_metrics_while_writing(spark, tmp_path):
    preds = spark.createDataFrame([(i, float(i % 3), float(i % 2), float((i * i) % 3)) for i in range(90)],
                                  "id long, label double, p double, q double").repartition(4)
    cols = {"one": "p", "two": "q"}
    path = str(tmp_path / "out")
    got = write_with_metrics(preds, path, cols, [0, 1, 2])
    want = metrics_report(preds, cols)
    assert rows(got) == rows(want.select(got.columns))
    assert rows(spark.read.parquet(path)) == rows(preds)
    assert write_with_metrics(preds.limit(0), path, cols, [0, 1, 2]).count() == 0


@pytest.mark.parametrize("odd", [(1, None, 0.0), (1, 0.0, None), (1, 7.0, 0.0)])
def test_rows_outside_the_classes(spark, tmp_path, odd):
    preds = spark.createDataFrame([(0, 0.0, 0.0), odd], "id long, label double, p double")
    with pytest.raises(ValueError, match="outside"):
        write_with_metrics(preds, str(tmp_path / "out"), {"m": "p"}, [0, 1])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError, match="classes"):
        write_with_metrics(preds, str(tmp_path / "none"), {"m": "p"}, [])


def test_models_after_metrics_while_writing(spark, tmp_path):
    """Binary classifiers fitted after a report was counted can still be sent to executors."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.linalg import Vectors
    preds = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0)], "label double, p double")
    write_with_metrics(preds, str(tmp_path / "out"), {"m": "p"}, [0, 1])
    data = spark.createDataFrame([(Vectors.dense([float(i), 1.0]), float(i > 20)) for i in range(40)], ["features", "label"])
    for estimator in (LogisticRegression(maxIter=5), LinearSVC(maxIter=5)):
        assert estimator.fit(data).transform(data).where("prediction >= 0").count() == 40
