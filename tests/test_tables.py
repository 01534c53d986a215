"""Models saved as long tables, and predictions written with their metrics."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from revlens.operators.linear import coefficient_table, vector_to_long
from revlens.plans.relational import count_vector_nb
from revlens.plans.tables import (
    load_tables, save_linear, save_nb, save_tables, score_linear_tables, score_nb_tables,
)


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [(i, float(i % 3 == 0), "test" if i % 5 == 0 else "train", [f"w{(i * j) % 17}" for j in range(i % 9)] + ["hot"] * (i % 4))
            for i in range(300)]
    return spark.createDataFrame(docs, "doc_id long, label double, split string, words array<string>").cache()


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 3])
def test_nb_round_trip(spark, corpus, tmp_path, broadcast_rows):
    """The same predictions as the fitted model, by broadcast and by sort-merge join."""
    model = count_vector_nb(corpus, 10)
    path = str(tmp_path / "nb")
    assert save_nb(spark, path, model, 10) == 1
    test = corpus.where("split = 'test'").select("doc_id", "label", "words")
    got = score_nb_tables(load_tables(spark, path), test, broadcast_rows=broadcast_rows)
    assert rows(got) == rows(model.predictions.select(got.columns))


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 3])
def test_linear_round_trip(spark, corpus, tmp_path, broadcast_rows):
    data = HashingTF(inputCol="words", outputCol="features", numFeatures=64).transform(corpus)
    lr = LogisticRegression(maxIter=20, regParam=0.01).fit(data)
    path = str(tmp_path / "lr")
    save_linear(spark, path, coefficient_table(spark, lr.coefficients), lr.intercept, 64)
    want = lr.transform(data).select("doc_id", vector_to_array("rawPrediction")[1].alias("margin"), "prediction")
    got = score_linear_tables(load_tables(spark, path), vector_to_long(data, "features"), data.select("doc_id"),
                              broadcast_rows=broadcast_rows)
    assert rows(got) == rows(want)


def test_versions(spark, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(ValueError, match="no model"):
        load_tables(spark, path)
    one, two = (spark.range(n).withColumn("w", F.lit(1.0)) for n in (1, 2))
    assert save_tables(spark, path, "linear", {"coefficients": one}, {"a": 1}) == 1
    two.write.parquet(f"{path}/v2/coefficients")  # a save that failed before its manifest
    assert load_tables(spark, path).version == 1
    assert save_tables(spark, path, "linear", {"coefficients": two}, {"a": 2}) == 2
    latest, first = load_tables(spark, path), load_tables(spark, path, 1)
    assert (latest.settings, latest.tables["coefficients"].count()) == ({"a": 2}, 2)
    assert (first.settings, first.tables["coefficients"].count()) == ({"a": 1}, 1)
    with pytest.raises(ValueError, match="version 5"):
        load_tables(spark, path, 5)
    with pytest.raises(ValueError, match="not 'nb'"):
        score_nb_tables(first, one)


def test_evaluate_writes_predictions(spark, tmp_path):
    from revlens.cli import evaluate_saved, train
    data = tmp_path / "data"
    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "good fine film").otherwise("bad dull film").alias("text"))
    texts.write.parquet(str(data / "documents.parquet"))
    texts.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality")).write.parquet(str(data / "labels.parquet"))
    model = str(tmp_path / "model")
    want = train(spark, "tfidf", str(data), model, ("nb",))
    got = evaluate_saved(spark, model, str(data), str(tmp_path / "out"))
    assert rows(got) == rows(want.select(got.columns))
    assert spark.read.parquet(str(tmp_path / "out")).count() == got.first()["n"] > 0
