"""Registered model queries.

MLlib fits cannot be restated in SQL, so most of these return check rows
``(check_name, ok)`` whose expected value is constant (the invariants of
probabilities agree with predictions, save -> load gives the same
predictions ...).  MLlib naive Bayes over our relational vocabulary and the
HashingTF mass have exact SQL oracles.  All models run at the reference's
settings.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizerModel, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators import termstats as ts
from revlens.operators.evaluate import evaluate, metrics_report
from revlens.operators.linear import coefficient_table, linear_margin, vector_to_long
from revlens.operators.prepare import hash_split, with_split
from revlens.operators.skew import hot_and_cold, hot_cold_join, top_keys
from revlens.operators.stem import stem_tokens
from revlens.plans.catalog import VOCAB_SIZE, _corpus
from revlens.plans.oracle import _corpus as _corpus_sql
from revlens.plans.oracle import _count_vector_nb, _doc_words, _review_corpus, _reviews
from revlens.plans.pipelines import (
    LR_L2_PARAMS, LR_PARAMS, NB_PARAMS, W2V_PARAMS, concurrently, fit_extractor, fit_text_pipeline, fit_word2vec_pipeline,
    prepare_stages, score, tfidf_stages,
)
from revlens.session import keep, scratch_path, shuffles_released
from revlens.sources import labelled_documents, read_table
from revlens.sources.tables import documents

TOL = 1e-6


def _checks(df: DataFrame, **named) -> DataFrame:
    """One aggregation over ``df`` -> rows ``(check_name, ok)``."""
    row = df.agg(*[c.alias(k) for k, c in named.items()])
    pairs = ", ".join(f"'{k}', `{k}`" for k in named)
    return row.select(F.expr(f"stack({len(named)}, {pairs}) AS (check_name, ok)"))


def _const_sql(*names: str) -> str:
    rows = ", ".join(f"('{n}', true)" for n in names)
    return f"SELECT * FROM (VALUES {rows}) AS t(check_name, ok)"


def _with_margin(spark, pred: DataFrame, features_col: str, model) -> DataFrame:
    """``pred`` plus ``margin`` recomputed relationally (long features x broadcast coefficients)."""
    pred = keep(pred)
    long = vector_to_long(pred, features_col)
    return linear_margin(long, coefficient_table(spark, model.coefficients), model.intercept, pred)


def _split_labelled(spark, sf_dir):
    return hash_split(labelled_documents(spark, sf_dir))


# --- exact oracles --------------------------------------------------------------

def q_hashing_tf_mass(spark, sf_dir):
    """HashingTF(1000) over ML Tokenizer + StopWordsRemover: each document's
    counts add up to its number of words."""
    model = PipelineModel(stages=prepare_stages() + [HashingTF(inputCol="words", outputCol="tf",
                                                               numFeatures=1000)])
    out = model.transform(documents(spark, sf_dir))
    return out.select("doc_id", F.aggregate(vector_to_array("tf"), F.lit(0.0),
                                            lambda a, x: a + x).alias("mass"))


def q_hashing_tf_rows(spark, sf_dir):
    """HashingTF(1000) vectors of all documents against the relational way: each
    distinct term's own bucket joined to the term counts and summed.  One row per
    document: its mass, and whether every bucket agrees."""
    hashing = HashingTF(inputCol="words", outputCol="tf", numFeatures=1000)
    words = PipelineModel(stages=prepare_stages()).transform(documents(spark, sf_dir)).select("doc_id", "words")
    # both sides as one array of (idx, value) a document: a pair of rows a bucket would be a second corpus to join
    at_places = F.transform(vector_to_array("tf"), lambda v, i: F.struct(i.alias("idx"), v.alias("value")))
    theirs = hashing.transform(words).select("doc_id", F.filter(at_places, lambda p: p["value"] != 0.0).alias("p")) \
        .groupBy("doc_id").agg(F.flatten(F.collect_list("p")).alias("theirs"))
    tf = ts.term_frequency(words, "words")
    path = scratch_path(spark, "hashed-terms")   # three branches read the terms' counts and buckets
    counts = ts.document_frequency(words, "words")
    single = hashing.transform(counts.select("term", "df", F.array("term").alias("words")))
    single.select("term", "df", F.array_position(vector_to_array("tf"), 1.0).alias("at")).write.parquet(path)
    terms = spark.read.schema("term string, df long, at long").parquet(path)
    mine = (hot_cold_join(tf, terms.select("term", "at"), "term", top_keys(terms, "term", "df"))
            .groupBy("doc_id", (F.col("at") - 1).cast("int").alias("idx")).agg(F.sum("tf").cast("double").alias("value"))
            .groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("mine")))
    mass = F.aggregate("theirs", F.lit(0.0), lambda a, p: a + p["value"])
    same = F.sort_array(F.array_distinct("theirs")) == F.col("mine")
    per_doc = theirs.join(mine, "doc_id", "left").where((F.size("theirs") > 0) | F.col("mine").isNotNull()).select(
        "doc_id", mass.alias("mass"), F.coalesce(same, F.lit(False)).alias("same"))
    return words.select("doc_id").join(per_doc, "doc_id", "left").select(
        "doc_id", F.coalesce("mass", F.lit(0.0)).alias("mass"), F.coalesce("same", F.lit(True)).alias("same"))


def q_mllib_nb_predict(spark, sf_dir):
    """MLlib NaiveBayes over a CountVectorizerModel built from the relational
    top-k vocabulary: same predictions as the relational naive Bayes."""
    corpus = _corpus(spark, sf_dir)
    train = corpus.where(F.col("split") == "train")
    # The vocabulary is at most VOCAB_SIZE terms; MLlib takes it as an array.
    terms = [r.term for r in ts.vocabulary(train, "words", VOCAB_SIZE).orderBy("idx").collect()]
    cv = CountVectorizerModel.from_vocabulary(terms, inputCol="words", outputCol="tf")
    feats = cv.transform(corpus)
    nb = NaiveBayes(featuresCol="tf", labelCol="label", **NB_PARAMS)
    model = nb.fit(feats.where(F.col("split") == "train"))
    return model.transform(feats.where(F.col("split") == "test")).select("doc_id", "label", "prediction")


# --- invariants of fitted models --------------------------------------------------

def q_lr_predict_check(spark, sf_dir):
    train, test = _split_labelled(spark, sf_dir)
    st, col = tfidf_stages()
    fp = fit_text_pipeline(train, st, col, ("lr",))
    lr = fp.model.stages[-1]
    pred = _with_margin(spark, fp.transform(test), col, lr)
    raw1 = vector_to_array("LR_rawPrediction")[1]
    p1 = vector_to_array("LR_probability")[1]
    hist = lr.summary.objectiveHistory
    return _checks(
        pred,
        margin_matches_raw=F.max(F.abs(F.col("margin") - raw1)) < TOL,
        probability_agrees=F.sum(((p1 > 0.5) != (F.col("LR_prediction") == 1.0)).cast("int")) == 0,
        objective_decreased=F.lit(hist[-1] <= hist[0]),
    )


def q_svc_predict_check(spark, sf_dir):
    train, test = _split_labelled(spark, sf_dir)
    st, col = tfidf_stages()
    fp = fit_text_pipeline(train, st, col, ("svm",))
    svm = fp.model.stages[-1]
    pred = _with_margin(spark, fp.transform(test), col, svm)
    raw1 = vector_to_array("SVM_rawPrediction")[1]
    return _checks(
        pred,
        margin_matches_raw=F.max(F.abs(F.col("margin") - raw1)) < TOL,
        prediction_is_sign=F.sum(((raw1 > 0) != (F.col("SVM_prediction") == 1.0)).cast("int")) == 0,
    )


def _w2v(spark, sf_dir, classifiers=("lr",)):
    train, test = _split_labelled(spark, sf_dir)
    fp = fit_word2vec_pipeline(train, classifiers)
    return fp, test


def q_lr_l2_check(spark, sf_dir):
    fp, test = _w2v(spark, sf_dir)
    lr = fp.model.stages[-1]
    pred = _with_margin(spark, fp.transform(test), "word2vec", lr)
    raw1 = vector_to_array("LR_rawPrediction")[1]
    p1 = vector_to_array("LR_probability")[1]
    hist = lr.summary.objectiveHistory
    return _checks(
        pred,
        objective_decreased=F.lit(hist[-1] < hist[0]),
        margin_matches_raw=F.max(F.abs(F.col("margin") - raw1)) < TOL,
        probability_agrees=F.sum(((p1 > 0.5) != (F.col("LR_prediction") == 1.0)).cast("int")) == 0,
    )


def _recomputed_means(spark, sf_dir):
    """``doc_id, dims, err`` for all documents: Word2Vec's document vector against the sum of the
    vectors of known words divided by the number of all words, from the table of vectors."""
    fp, _ = _w2v(spark, sf_dir)
    path = scratch_path(spark, "document-vectors")  # read by four branches
    with shuffles_released(spark):
        fp.transform(documents(spark, sf_dir)).select("doc_id", "w2v_words", vector_to_array("word2vec").alias("v")).write.parquet(path)
    out = spark.read.schema("doc_id long, w2v_words array<string>, v array<double>").parquet(path)
    vectors = fp.vectors.table.select(F.col("word").alias("term"), F.col("vector").alias("wv"))
    # a vector is 400 bytes: the more words meet theirs by broadcast, the fewer are shuffled
    hot = top_keys(ts.document_frequency(out, "w2v_words"), "term", "df", 20_000)
    hot_sums, cold_sums = _document_sums(out, vectors, hot, W2V_PARAMS["vectorSize"])
    mine = out.select("doc_id", "v", F.greatest(F.size("w2v_words"), F.lit(1)).alias("n")) \
        .join(hot_sums.withColumnRenamed("s", "hot"), "doc_id", "left").join(cold_sums.withColumnRenamed("s", "cold"), "doc_id", "left")
    zeros = F.array_repeat(F.lit(0.0), W2V_PARAMS["vectorSize"])
    sums = F.zip_with(F.coalesce("hot", zeros), F.coalesce("cold", zeros), lambda x, y: x + y)
    off = F.zip_with("v", sums, lambda v, x: F.abs(v - x / F.col("n")))
    return mine.select("doc_id", F.size("v").alias("dims"), F.array_max(off).alias("err"))


def _document_sums(out: DataFrame, vectors: DataFrame, hot: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, s``: the sum of the vectors (``term, wv``) of a document's ``w2v_words``, over hot words and over the others.

    Documents are dealt once; their words are counted and hot words' vectors summed where they are.  Partial sums
    are larger than the rows they are made of, so the other words' vectors are dealt by document before they are summed.
    """
    tf = ts.term_frequency(out.select("doc_id", "w2v_words").repartition("doc_id"), "w2v_words")
    hot_rows, cold_rows = hot_and_cold(tf, vectors, "term", hot)
    total = F.array(*[F.sum(F.col("wv")[i].cast("double") * F.col("tf")) for i in range(size)]).alias("s")
    return (hot_rows.groupBy("doc_id").agg(total),
            cold_rows.select("doc_id", "wv", "tf").repartition("doc_id").groupBy("doc_id").agg(total))


def q_word2vec_rows(spark, sf_dir):
    """Word2Vec vector of every document: its length, and whether it equals the recomputed mean."""
    return _recomputed_means(spark, sf_dir).select("doc_id", "dims", (F.col("err") < TOL).alias("is_mean"))


def q_doc_vector_mean(spark, sf_dir):
    """Word2Vec document vectors equal the recomputed means on all documents."""
    n = documents(spark, sf_dir, ["doc_id"]).count()
    return _checks(_recomputed_means(spark, sf_dir), mean_matches_model=F.max("err") < TOL,
                   all_documents_scored=F.count_distinct("doc_id") == F.lit(n))


def _embeddings(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return with_split(emb.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>"))
                                 .alias("features"), F.col("label").cast("double").alias("label")),
                      "vec_id")


def q_lr_multiclass(spark, sf_dir):
    data = _embeddings(spark, sf_dir)
    lr = LogisticRegression(featuresCol="features", labelCol="label", family="multinomial",
                            maxIter=LR_PARAMS["maxIter"], regParam=LR_PARAMS["regParam"])
    model = lr.fit(data.where(F.col("split") == "train"))
    pred = model.transform(data.where(F.col("split") == "test"))
    prob = vector_to_array("probability")
    raw = vector_to_array("rawPrediction")
    argmax = F.array_position(raw, F.array_max(raw)) - 1
    n_labels = data.select("label").distinct().count()
    return _checks(
        pred,
        one_class_per_label=F.lit(model.numClasses == n_labels),
        probabilities_sum_to_one=F.max(F.abs(F.aggregate(prob, F.lit(0.0), lambda a, x: a + x) - 1.0)) < TOL,
        prediction_is_argmax=F.sum((argmax.cast("double") != F.col("prediction")).cast("int")) == 0,
    )


def q_embedding_classifier(spark, sf_dir):
    """Stored vectors -> logistic regression; our one-pass evaluation equals MLlib's evaluator."""
    data = _embeddings(spark, sf_dir)
    model = LogisticRegression(featuresCol="features", labelCol="label",
                               maxIter=LR_PARAMS["maxIter"], regParam=LR_PARAMS["regParam"]).fit(data.where(F.col("split") == "train"))
    pred = keep(model.transform(data.where(F.col("split") == "test")))
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
    acc = ev.setMetricName("accuracy").evaluate(pred)
    f1 = ev.setMetricName("f1").evaluate(pred)
    mine = evaluate(pred)
    return _checks(mine,
                   accuracy_matches_mllib=F.abs(F.first("accuracy") - F.lit(acc)) < 1e-9,
                   f1_matches_mllib=F.abs(F.first("f1") - F.lit(f1)) < 1e-9)


# --- persistence, scoring, report --------------------------------------------------

def q_model_roundtrip(spark, sf_dir):
    train, test = _split_labelled(spark, sf_dir)
    st, col = tfidf_stages()
    fp = fit_text_pipeline(train, st, col, ("nb", "lr", "svm"))
    path = scratch_path(spark, "model-tfidf")
    fp.model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    cols = ["doc_id", "NB_prediction", "LR_prediction", "SVM_prediction"]
    a = fp.model.transform(test).select(*cols)
    b = loaded.transform(test).select(*[F.col(c).alias(f"b_{c}") if c != "doc_id" else c for c in cols])
    both = a.join(b, "doc_id", "full")
    same = F.sum(sum(((F.col(c) != F.col(f"b_{c}")) | F.col(f"b_{c}").isNull() | F.col(c).isNull())
                     .cast("int") for c in cols[1:])) == 0
    return _checks(both, same_predictions=same,
                   same_stage_count=F.lit(len(loaded.stages) == len(fp.model.stages)))


def q_score_and_write(spark, sf_dir):
    """Batch scoring job: fit on labelled documents, score every conversation turn (some
    without a text) with the chosen classifier, write, read back, compare with a direct transform."""
    train, _ = _split_labelled(spark, sf_dir)
    st, col = tfidf_stages()
    fp = fit_text_pipeline(train, st, col, ("lr", "nb"))
    turns = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"]) \
        .withColumn("text", F.when(F.col("turn") % 7 != 3, F.col("text")))
    path = scratch_path(spark, "predictions")
    score(turns, fp, "lr", id_col=["conv_id", "turn"]).write.mode("overwrite").parquet(path)
    direct = fp.model.transform(turns.fillna({"text": ""})) \
        .select("conv_id", "turn", F.col("LR_prediction").alias("direct"), F.col("NB_prediction").alias("other"))
    both = spark.read.parquet(path).join(direct, ["conv_id", "turn"], "full")
    n_in = turns.count()
    return _checks(both, all_rows_written=F.count("prediction") == F.lit(n_in),
                   choice_matters=F.sum((F.col("direct") != F.col("other")).cast("int")) > 0,
                   same_as_direct=F.sum((~F.col("prediction").eqNullSafe(F.col("direct"))).cast("int")) == 0)


def q_stream_score(spark, sf_dir):
    """Structured Streaming scorer over the conversations file equals batch scoring."""
    from revlens.streaming import score_files
    train, _ = _split_labelled(spark, sf_dir)
    st, col = tfidf_stages()
    fp = fit_text_pipeline(train, st, col, ("nb",))
    schema = read_table(spark, sf_dir, "conversations").schema
    # the table may be one file or a folder of files; as a pattern, the path stands for either
    sink = score_files(spark, f"{sf_dir.rstrip('/')}/conversation[s].parquet", schema, fp, "nb", ["conv_id", "turn"],
                       scratch_path(spark, "stream-predictions"), scratch_path(spark, "stream-checkpoint"))
    streamed = spark.read.parquet(sink).withColumnRenamed("prediction", "streamed")
    batch = score(read_table(spark, sf_dir, "conversations"), fp, "nb", id_col=["conv_id", "turn"])
    both = batch.join(streamed, ["conv_id", "turn"], "full")
    return _checks(both,
                   same_as_batch=F.sum((~F.col("prediction").eqNullSafe(F.col("streamed"))).cast("int")) == 0,
                   all_rows_scored=F.count(F.lit(1)) == F.lit(batch.count()))


def q_word2vec_roundtrip(spark, sf_dir):
    """Saved word2vec model (preparation + stemming job + Word2Vec + classifiers)
    reloads and predicts the same."""
    from revlens.plans.persist import load_fitted, save_fitted
    fp, test = _w2v(spark, sf_dir, ("lr", "svm"))
    path = scratch_path(spark, "model-w2v")
    save_fitted(spark, fp, path, "word2vec")
    loaded, extractor = load_fitted(spark, path)
    a = score(test, fp, "svm").withColumnRenamed("prediction", "a")
    b = score(test, loaded, "svm").withColumnRenamed("prediction", "b")
    both = a.join(b, "doc_id", "full")
    return _checks(both, same_predictions=F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("int")) == 0,
                   extractor_recorded=F.lit(extractor == "word2vec"))


def q_score_lines(spark, sf_dir):
    """The batch scoring command: train + save an n-gram model, write every
    conversation text as lines, score one prediction per line."""
    from revlens.cli import score_lines, train
    from revlens.plans.persist import load_fitted
    model_dir = scratch_path(spark, "model-ngram")
    train(spark, "ngram", sf_dir, model_dir, ("nb",))
    lines_dir = scratch_path(spark, "lines")
    read_table(spark, sf_dir, "conversations", ["text"]).dropna().write.mode("overwrite").text(lines_dir)
    out = spark.read.parquet(score_lines(spark, model_dir, "nb", lines_dir, scratch_path(spark, "scored")))
    lines = spark.read.text(lines_dir).withColumnRenamed("value", "text")
    n_lines = lines.count()
    fitted, _ = load_fitted(spark, model_dir)
    direct = fitted.transform(lines.distinct()).select(F.col("text").alias("t"), F.col("NB_prediction").alias("direct"))
    both = out.join(direct, F.col("text") == F.col("t"), "left")
    return _checks(both, one_prediction_per_line=F.count(F.lit(1)) == F.lit(n_lines),
                   unique_line_ids=F.count_distinct("line_id") == F.lit(n_lines),
                   same_as_direct=F.sum((~F.col("prediction").eqNullSafe(F.col("direct"))).cast("int")) == 0)


def q_stemmed_tfidf_evaluate(spark, sf_dir):
    """Stop words + stem + hashed TF-IDF + NB / LR / SVM: train and save, then
    reload and evaluate (the reference's train and evaluate scripts); the
    reloaded model reports the same metrics."""
    from revlens.cli import evaluate_saved, train
    model_dir = scratch_path(spark, "model-stem-tfidf")
    trained = train(spark, "tfidf", sf_dir, model_dir, stem=True).withColumnRenamed("accuracy", "a1").withColumnRenamed("f1", "f1_1")
    reloaded = evaluate_saved(spark, model_dir, sf_dir)
    both = trained.join(reloaded, "model", "full")
    return _checks(both,
                   same_accuracy=F.max(F.abs(F.col("a1") - F.col("accuracy"))) < 1e-12,
                   same_f1=F.max(F.abs(F.col("f1_1") - F.col("f1"))) < 1e-12,
                   three_models=F.count(F.lit(1)) == 3)


def _five_class(spark, sf_dir, extractor, stem=None):
    """5-class logistic regression on the star rating itself (ratings 1..5 as
    classes 0..4, no binarization) over one extractor's features."""
    from revlens.operators.prepare import drop_null_reviews
    from revlens.sources import reviews
    r = drop_null_reviews(reviews(spark, sf_dir)).withColumn("label", F.col("score") - 1.0)
    train, test = hash_split(r)
    params = LR_L2_PARAMS if extractor == "word2vec" else LR_PARAMS
    fp = fit_extractor(train, extractor, ("lr",), stem, lr_params={**params, "family": "multinomial"})
    lr = fp.model.stages[-1]
    pred = fp.transform(test)
    prob = vector_to_array("LR_probability")
    raw = vector_to_array("LR_rawPrediction")
    argmax = F.array_position(raw, F.array_max(raw)) - 1
    return _checks(
        pred,
        five_classes=F.lit(lr.numClasses == 5),
        probabilities_sum_to_one=F.max(F.abs(F.aggregate(prob, F.lit(0.0), lambda a, x: a + x) - 1.0)) < TOL,
        prediction_is_argmax=F.sum((argmax.cast("double") != F.col("LR_prediction")).cast("int")) == 0,
    )


def q_lr_five_class(spark, sf_dir):
    """Five classes on hashed TF-IDF."""
    return _five_class(spark, sf_dir, "tfidf")


def q_lr_five_class_stem(spark, sf_dir):
    """Five classes on hashed TF-IDF of stems."""
    return _five_class(spark, sf_dir, "tfidf", stem=True)


def q_lr_five_class_word2vec(spark, sf_dir):
    """Five classes on word2vec."""
    return _five_class(spark, sf_dir, "word2vec")


# Stems of the published Porter2 vocabulary for words the documents hold.
GOLDEN_STEMS = {"license": "licens", "licensed": "licens", "public": "public", "released": "releas", "reserved": "reserv",
                "rights": "right", "general": "general", "version": "version", "apache": "apach", "token": "token",
                "pathetic": "pathet", "worthless": "worthless"}


def q_stem_tokens(spark, sf_dir):
    """Stems of all documents: one row per document with its words, its stems, and whether the
    stems of words from the published vocabulary are the published ones."""
    words = PipelineModel(stages=prepare_stages()).transform(documents(spark, sf_dir))
    golden = F.create_map(*[F.lit(x) for kv in GOLDEN_STEMS.items() for x in kv])
    pairs = F.filter(F.arrays_zip("words", "stems"), lambda p: p["words"].isin(*GOLDEN_STEMS))
    return stem_tokens(words, "words", "stems").select(
        "doc_id", F.size("words").alias("n_words"), F.size("stems").alias("n_stems"), F.size(pairs).alias("n_golden"),
        F.forall(pairs, lambda p: golden[p["words"]] == p["stems"]).alias("golden_ok"))


def q_stem_consistency(spark, sf_dir):
    """Every word keeps its place: looking a word up among the stemmed distinct
    words of its document gives the stem at the word's position."""
    words = PipelineModel(stages=prepare_stages()).transform(documents(spark, sf_dir)).select("doc_id", "words")
    once = stem_tokens(words.withColumn("once", F.array_distinct("words")), "once", "once_stems")
    stemmed = stem_tokens(once, "words", "stems")
    # every (word, stem) of a place is one of the distinct words' pairs: sets of strings, no search per token
    pair = lambda words, stems: F.zip_with(words, stems, lambda w, s: F.concat(w, F.lit(" "), s))
    strange = F.array_except(pair("words", "stems"), pair("once", "once_stems"))
    return _checks(stemmed,
                   same_stems=F.sum((F.size(strange) > 0).cast("int")) == 0,
                   same_lengths=F.sum((F.size("stems") != F.size("words")).cast("int")) == 0)


def q_metrics_report(spark, sf_dir):
    """Every extractor x classifier pair on the test split: our one-pass accuracy and weighted
    F1 against MLlib's evaluator on the same predictions."""
    train, test = _split_labelled(spark, sf_dir)
    rows = []
    extractors = ("tfidf", "ngram", "word2vec")
    # independent fits: their many small jobs run side by side
    for extractor, fp in zip(extractors, concurrently(spark, lambda x: fit_extractor(train, x), extractors)):
        cols = {c: f"{c.upper()}_prediction" for c in sorted(fp.classifiers)}
        pred = keep(fp.transform(test).select("label", *cols.values()))
        for r in metrics_report(pred, cols).collect():  # one row per classifier
            ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol=cols[r["model"]])
            same = [abs(r[name] - ev.setMetricName(metric).evaluate(pred)) < 1e-9
                    for name, metric in (("accuracy", "accuracy"), ("f1", "f1"))]
            rows.append((extractor, r["model"], r["n"], *same))
        pred.unpersist()
    return spark.createDataFrame(rows, "extractor string, model string, n long, accuracy_ok boolean, f1_ok boolean")


def q_csv_stable_split(spark, sf_dir):
    """Review CSV files without ids, scanned with large and with small splits: every review gets
    the same id, hence the same side of the train / test split."""
    from revlens.sources import read_reviews_csv, reviews, write_reviews_csv
    path = scratch_path(spark, "reviews-without-ids")
    write_reviews_csv(reviews(spark, sf_dir).select("score", "text"), path)
    columns = {"score": "score", "text": "text"}
    whole = with_split(read_reviews_csv(spark, path, columns), "doc_id")
    other = spark.newSession()  # has its own settings
    other.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    other.conf.set("spark.sql.files.openCostInBytes", "0")
    cut_path = scratch_path(spark, "reviews-in-small-splits")
    with_split(read_reviews_csv(other, path, columns), "doc_id").write.parquet(cut_path)
    cut = spark.read.parquet(cut_path).withColumnsRenamed({"score": "score2", "text": "text2", "split": "split2"})
    return whole.join(cut, "doc_id", "full").select(
        F.md5("text").alias("text_md5"), "score",
        (F.col("text").eqNullSafe(F.col("text2")) & F.col("score").eqNullSafe(F.col("score2"))).alias("same_row"),
        F.col("split").eqNullSafe(F.col("split2")).alias("same_split"))


def q_train_from_csv(spark, sf_dir):
    """Training from review CSV files: write them with the reference's column names and two more,
    read by name, binarize, reject other ratings, fit and predict with the relational naive Bayes."""
    from revlens.plans.relational import build_corpus, count_vector_nb
    from revlens.sources import labelled_reviews, reviews, write_reviews_csv
    path = scratch_path(spark, "reviews-named-csv")
    r = reviews(spark, sf_dir).withColumn("score", F.when(F.col("doc_id") % 13 == 0, F.lit(7.0)).otherwise(F.col("score")))
    write_reviews_csv(r.select(F.col("doc_id").alias("Id"), F.lit("a title").alias("Title"),
                               F.col("score").alias("review/score"), F.col("text").alias("review/text")), path)
    labelled = labelled_reviews(spark, path, {"doc_id": "Id", "score": "review/score", "text": "review/text"})
    return count_vector_nb(build_corpus(labelled)).predictions.select(
        "doc_id", "label", "prediction", F.round("score", 6).alias("score"))


ML_QUERIES = {
    "hashing_tf_mass": q_hashing_tf_mass,
    "hashing_tf_rows": q_hashing_tf_rows,
    "mllib_nb_predict": q_mllib_nb_predict,
    "lr_predict_check": q_lr_predict_check,
    "svc_predict_check": q_svc_predict_check,
    "lr_l2_check": q_lr_l2_check,
    "word2vec_rows": q_word2vec_rows,
    "doc_vector_mean": q_doc_vector_mean,
    "lr_multiclass": q_lr_multiclass,
    "embedding_classifier": q_embedding_classifier,
    "model_roundtrip": q_model_roundtrip,
    "score_and_write": q_score_and_write,
    "stream_score": q_stream_score,
    "word2vec_roundtrip": q_word2vec_roundtrip,
    "score_lines": q_score_lines,
    "stemmed_tfidf_evaluate": q_stemmed_tfidf_evaluate,
    "lr_five_class": q_lr_five_class,
    "lr_five_class_stem": q_lr_five_class_stem,
    "lr_five_class_word2vec": q_lr_five_class_word2vec,
    "csv_stable_split": q_csv_stable_split,
    "train_from_csv": q_train_from_csv,
    "stem_tokens": q_stem_tokens,
    "stem_consistency": q_stem_consistency,
    "metrics_report": q_metrics_report,
}

_FIVE = _const_sql("five_classes", "probabilities_sum_to_one", "prediction_is_argmax")
_GOLDEN = ", ".join(f"'{w}'" for w in GOLDEN_STEMS)
_PAIRS = ", ".join(f"('{e}', '{m}')" for e, ms in (("tfidf", ("nb", "lr", "svm")), ("ngram", ("nb", "lr", "svm")),
                                                  ("word2vec", ("lr", "svm"))) for m in ms)

ML_ORACLE_SQL = {
    "hashing_tf_rows": f"WITH {_doc_words()} SELECT doc_id, CAST(len(words) AS DOUBLE) AS mass, true AS same FROM doc_words",
    "word2vec_rows": f"SELECT doc_id, CAST({W2V_PARAMS['vectorSize']} AS INTEGER) AS dims, true AS is_mean FROM documents",
    "stem_tokens": f"""WITH {_doc_words()} SELECT doc_id, CAST(len(words) AS INTEGER) AS n_words, CAST(len(words) AS INTEGER) AS n_stems,
CAST(len(list_filter(words, lambda w: list_contains([{_GOLDEN}], w))) AS INTEGER) AS n_golden, true AS golden_ok FROM doc_words""",
    "metrics_report": f"""WITH {_corpus_sql()} SELECT p.extractor, p.model, t.n, true AS accuracy_ok, true AS f1_ok
FROM (VALUES {_PAIRS}) AS p(extractor, model), (SELECT count(*) AS n FROM corp WHERE split = 'test') t""",
    "train_from_csv": f"WITH {_count_vector_nb(_review_corpus())} SELECT doc_id, label, prediction, round(score, 6) AS score FROM nb_out",
    "csv_stable_split": f"WITH {_reviews()} SELECT md5(text) AS text_md5, score, true AS same_row, true AS same_split FROM reviews",
    "lr_five_class_stem": _FIVE,
    "lr_five_class_word2vec": _FIVE,
    "hashing_tf_mass": f"WITH {_doc_words()} SELECT doc_id, CAST(len(words) AS DOUBLE) AS mass FROM doc_words",
    "mllib_nb_predict": f"WITH {_count_vector_nb()} SELECT doc_id, label, prediction FROM nb_out",
    "lr_predict_check": _const_sql("margin_matches_raw", "probability_agrees", "objective_decreased"),
    "svc_predict_check": _const_sql("margin_matches_raw", "prediction_is_sign"),
    "lr_l2_check": _const_sql("objective_decreased", "margin_matches_raw", "probability_agrees"),
    "doc_vector_mean": _const_sql("mean_matches_model", "all_documents_scored"),
    "lr_multiclass": _const_sql("one_class_per_label", "probabilities_sum_to_one", "prediction_is_argmax"),
    "embedding_classifier": _const_sql("accuracy_matches_mllib", "f1_matches_mllib"),
    "model_roundtrip": _const_sql("same_predictions", "same_stage_count"),
    "score_and_write": _const_sql("all_rows_written", "choice_matters", "same_as_direct"),
    "stem_consistency": _const_sql("same_stems", "same_lengths"),
    "stream_score": _const_sql("same_as_batch", "all_rows_scored"),
    "stemmed_tfidf_evaluate": _const_sql("same_accuracy", "same_f1", "three_models"),
    "lr_five_class": _const_sql("five_classes", "probabilities_sum_to_one", "prediction_is_argmax"),
    "word2vec_roundtrip": _const_sql("same_predictions", "extractor_recorded"),
    "score_lines": _const_sql("one_prediction_per_line", "unique_line_ids", "same_as_direct"),
}
