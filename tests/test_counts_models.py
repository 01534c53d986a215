"""Counting, IDF, naive Bayes, evaluation, skew join (FIXTURES.md section 4)."""

import math

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from revlens.operators import termstats as ts
from revlens.operators.evaluate import evaluate, metrics_report
from revlens.operators.naive_bayes import fit_nb, score_nb
from revlens.operators.skew import hot_cold_join, top_keys

FOUR = [(0, ["a"]), (1, ["a", "b", "c"]), (2, []), (3, ["a", "", "b"])]


@pytest.fixture
def four(spark):
    return spark.createDataFrame(FOUR, "doc_id long, words array<string>")


def test_idf_fixture(spark, four):
    got = {r.term: (r.df, round(r.idf, 6)) for r in ts.idf_weights(four, "words", ts.count_rows(four)).collect()}
    assert got == {"a": (3, 0.223144), "b": (2, 0.510826), "": (1, 0.916291), "c": (1, 0.916291)}
    got2 = {r.term: round(r.idf, 6) for r in ts.idf_weights(four, "words", ts.count_rows(four), 2).collect()}
    assert got2[""] == 0.0 and got2["c"] == 0.0 and got2["a"] == 0.223144


def test_vocabulary_ties_by_term(spark, four):
    got = [(r.term, r.idx, r.cf) for r in ts.vocabulary(four, "words", 3).orderBy("idx").collect()]
    assert got == [("a", 0, 3), ("b", 1, 2), ("", 2, 1)]


def test_tfidf_hot_and_cold_equals_broadcast(spark, four):
    tf = ts.term_frequency(four, "words")
    idf = ts.idf_weights(four, "words", ts.count_rows(four))
    a = sorted(tuple(r) for r in ts.tfidf(tf, idf, bounded=True).select("doc_id", "term", "tfidf").collect())
    b = sorted(tuple(r) for r in ts.tfidf(tf, idf, hot_keys=2).select("doc_id", "term", "tfidf").collect())
    assert a == b


def test_hot_cold_join_equals_join(spark):
    fact = spark.range(3000).select(F.col("id").alias("row"),
                                    F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
                                        F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"))
    dim = fact.select("key").distinct().withColumn("v", F.length("key"))
    hot = top_keys(fact.groupBy("key").count(), "key", "count", 1)
    j = hot_cold_join(fact, dim, "key", hot)
    assert j.count() == 3000
    some = dim.where("key <> 'k7' AND key <> 'hot'")
    left = hot_cold_join(fact, some, "key", hot, "left")
    assert left.count() == 3000 and left.where("v IS NULL").count() == fact.count() - fact.join(some, "key").count()
    assert sorted(tuple(r) for r in j.select("row", "v").collect()) == \
        sorted(tuple(r) for r in fact.join(dim, "key").select("row", "v").collect())


def test_hashing_tf_buckets(spark):
    h = HashingTF(numFeatures=1000)
    got = {t: h.indexOf(t) for t in ["a", "b", "great", "", "book", "reading", "abcdefgh"]}
    assert got == {"a": 467, "b": 165, "great": 750, "": 372, "book": 393, "reading": 526, "abcdefgh": 185}


NB_ROWS = [(0, 0.0, 1.5, 0.0), (1, 1.0, 0.0, 2.0), (2, 1.0, 1.0, 1.0)]


def test_naive_bayes_fixture(spark):
    rows = [(d, lab, i, v) for d, lab, f0, f1 in NB_ROWS for i, v in ((0, f0), (1, f1)) if v != 0]
    feats = spark.createDataFrame(rows, "doc_id long, label double, idx int, value double")
    docs = spark.createDataFrame([(d, lab) for d, lab, *_ in NB_ROWS], "doc_id long, label double")
    prior, theta = fit_nb(feats, docs, 2)
    pi = {r.label: round(r.pi, 6) for r in prior.collect()}
    th = {(r.label, r.idx): round(r.theta, 6) for r in theta.collect()}
    assert pi == {0.0: -0.916291, 1.0: -0.510826}
    assert th == {(0.0, 0): -0.336472, (1.0, 0): -1.098612, (1.0, 1): -0.405465}
    t0 = {r.label: round(r.theta0, 6) for r in prior.collect()}
    assert t0[0.0] == -1.252763        # unseen (class 0, feature 1)
    # scoring equals MLlib's NaiveBayes on the same data, including a doc with no feature
    ml_df = spark.createDataFrame([(lab, Vectors.dense([f0, f1])) for _, lab, f0, f1 in NB_ROWS],
                                  ["label", "features"])
    model = NaiveBayes(smoothing=1.0).fit(ml_df)
    test = [(10, [(0, 3.0)]), (11, [(1, 1.0)]), (12, [])]
    tfe = spark.createDataFrame([(d, i, v) for d, fs in test for i, v in fs],
                                "doc_id long, idx int, value double")
    tdocs = spark.createDataFrame([(d,) for d, _ in test], "doc_id long")
    mine = {r.doc_id: r.prediction for r in score_nb(tfe, tdocs, prior, theta).collect()}
    for d, fs in test:
        vec = [0.0, 0.0]
        for i, v in fs:
            vec[i] = v
        assert model.predict(Vectors.dense(vec)) == mine[d]


@pytest.mark.parametrize("pairs,acc,f1", [
    ([(0, 0)] * 3 + [(0, 1), (1, 0), (1, 1), (0, 2)], 0.571429, 0.619048),
    ([(0, 0), (0, 1), (1, 1), (1, 1), (1, 0)], 0.6, 0.6),
])
def test_evaluator_fixture(spark, pairs, acc, f1):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "label double, prediction double")
    r = evaluate(df).first()
    assert (round(r.accuracy, 6), round(r.f1, 6)) == (acc, f1)
    ev = MulticlassClassificationEvaluator(metricName="f1")
    assert math.isclose(ev.evaluate(df), r.f1, abs_tol=1e-12)


def test_metrics_report_one_row_per_model(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 1.0, 1.0)], "label double, a double, b double")
    got = {r.model: r.accuracy for r in metrics_report(df, {"m1": "a", "m2": "b"}).collect()}
    assert got == {"m1": 1.0, "m2": 0.5}


def test_naive_bayes_unbounded_path_equals_broadcast(spark):
    rows = [(d, lab, i, v) for d, lab, f0, f1 in NB_ROWS for i, v in ((0, f0), (1, f1)) if v != 0]
    feats = spark.createDataFrame(rows, "doc_id long, label double, idx int, value double")
    docs = spark.createDataFrame([(d, lab) for d, lab, *_ in NB_ROWS], "doc_id long, label double")
    prior, theta = fit_nb(feats, docs, 2)
    test = feats.select("doc_id", "idx", "value")
    a = sorted(tuple(r) for r in score_nb(test, docs.select("doc_id"), prior, theta, max_features=2).collect())
    b = sorted(tuple(r) for r in score_nb(test, docs.select("doc_id"), prior, theta).collect())
    assert a == b


def test_linear_margin_long_form(spark):
    from pyspark.ml.linalg import Vectors as V
    from revlens.operators.linear import coefficient_table, linear_margin, vector_to_long
    df = spark.createDataFrame([(1, V.sparse(4, [0, 2], [1.0, 2.0])), (2, V.dense([0.0, 0.0, 0.0, 0.0])),
                                (3, V.dense([1.0, 1.0, 1.0, 1.0]))], ["doc_id", "features"])
    coef = coefficient_table(spark, V.dense([0.5, 0.0, -1.0, 2.0]))
    got = {r.doc_id: r.margin for r in
           linear_margin(vector_to_long(df, "features"), coef, 0.25, df.select("doc_id")).collect()}
    assert got == {1: 0.5 - 2.0 + 0.25, 2: 0.25, 3: 0.5 - 1.0 + 2.0 + 0.25}


def test_checkpoint_root_is_shared_setting(spark):
    from revlens.session import checkpoint_root, scratch_path
    root = checkpoint_root(spark)
    assert root and scratch_path(spark, "x").startswith(root.rstrip("/"))


def test_idf_equals_mllib(spark):
    from pyspark.ml.feature import IDF, CountVectorizerModel
    docs = spark.createDataFrame([(0, ["a", "b", "a"]), (1, ["b", "c"]), (2, []), (3, ["a", "d", "d", ""])],
                                 "doc_id long, words array<string>")
    for min_df in (0, 2):
        mine = {r.term: r.idf for r in ts.idf_weights(docs, "words", ts.count_rows(docs), min_df).collect()}
        terms = sorted(mine)
        cv = CountVectorizerModel.from_vocabulary(terms, inputCol="words", outputCol="tf")
        model = IDF(inputCol="tf", outputCol="x", minDocFreq=min_df).fit(cv.transform(docs))
        theirs = dict(zip(terms, model.idf.toArray()))
        assert all(abs(mine[t] - theirs[t]) < 1e-12 for t in terms)


def test_concurrent_classifier_fit_equals_sequential_pipeline(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.linalg import Vectors as V
    from revlens.plans.pipelines import classifier_stages, fit_concurrently
    rows = [(float(i % 2), V.dense([float(i % 3), float((i * 7) % 5), 1.0 if i % 2 else 0.0])) for i in range(60)]
    df = spark.createDataFrame(rows, ["label", "features"]).cache()
    params = dict(lr_params={"maxIter": 20, "regParam": 0.01}, svm_params={"maxIter": 20, "regParam": 0.01})
    seq = Pipeline(stages=classifier_stages("features", "label", ("nb", "lr", "svm"), **params)).fit(df).stages
    con = fit_concurrently(classifier_stages("features", "label", ("nb", "lr", "svm"), **params), df)
    assert seq[0].theta.toArray().tolist() == con[0].theta.toArray().tolist()
    assert list(seq[1].coefficients) == list(con[1].coefficients) and seq[1].intercept == con[1].intercept
    assert list(seq[2].coefficients) == list(con[2].coefficients) and seq[2].intercept == con[2].intercept


def test_features_are_merged_by_their_bytes(spark):
    """Same rows in as few partitions as the bytes need; large features keep their partitions; no rows is fine."""
    from pyspark.ml.linalg import Vectors
    from pyspark.sql import functions as F

    from revlens.plans.pipelines import sized_for_rounds
    df = spark.createDataFrame([(Vectors.sparse(50, [i % 50], [float(i + 1)]), float(i % 2)) for i in range(200)], ["f", "label"]) \
        .repartition(8)
    one = sized_for_rounds(df, "f")
    many = sized_for_rounds(df, "f", target_bytes=1)
    key = lambda r: str(r)
    assert sorted(one.collect(), key=key) == sorted(df.collect(), key=key) == sorted(many.collect(), key=key)
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() > 1
    assert sized_for_rounds(df.where(F.col("label") > 5), "f").count() == 0
