"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query reads the generated tables (or data Spark derives from them) in
full.  Computed columns carry the same names as in ``revlens.plans.oracle``.
Doubles that come out of logs or sums are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.labels import IMDB_CLASS_MAP, TWITTER_CLASS_MAP, map_class_labels
from revlens.functions.text import clean_text, filter_short_tokens, ngrams, split_label, tokenize
from revlens.operators import termstats as ts
from revlens.operators.evaluate import confusion_matrix, evaluate
from revlens.operators.heavy import heavy_vocabulary
from revlens.operators.incremental import nb_from_statistics
from revlens.operators.observed import write_with_metrics
from revlens.operators.prepare import (
    add_words, binarize, drop_null_reviews, label_balance, prepare, with_split,
)
from revlens.plans.relational import (
    NGRAM_VOCAB_SIZES, VOCAB_SIZE, build_corpus, labelled_words, count_vector_nb, ngram_tfidf_features, ngram_tfidf_nb,
)
from revlens.plans.tables import load_tables, save_nb, score_nb_tables
from revlens.plans.term_tables import open_terms, store_terms
from revlens.session import scratch_path
from revlens.sources import (
    annotations, labelled_documents, read_lines, read_reviews_csv, reviews, reviews_with_nulls,
    write_reviews_csv,
)
from revlens.sources.committed import read_committed, write_committed
from revlens.sources.tables import documents


def _r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cleaned, tokenized, stop words removed."""
    docs = prepare(documents(spark, sf_dir), score_col=None, keep=["doc_id"])
    return add_words(docs).drop("text")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_corpus(labelled_documents(spark, sf_dir))


# --- projections, filters, labels -------------------------------------------

def q_clean_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", clean_text("text").alias("text"))


def q_drop_null_reviews(spark, sf_dir):
    return drop_null_reviews(reviews_with_nulls(spark, sf_dir)).select(
        "doc_id", "score", clean_text("text").alias("text"))


def q_binarize_score(spark, sf_dir):
    r = drop_null_reviews(reviews(spark, sf_dir))
    return binarize(r, "score", "label").select("doc_id", "score", "label")


def q_hash_split(spark, sf_dir):
    return documents(spark, sf_dir, ["doc_id"]).select("doc_id", split_label("doc_id").alias("split"))


def q_label_balance(spark, sf_dir):
    labelled = labelled_documents(spark, sf_dir).select("doc_id", "label")
    return label_balance(with_split(labelled))


def q_explode_annotations(spark, sf_dir):
    return annotations(spark, sf_dir).select(
        "event_id", F.explode("sentiment.result").alias("prediction"))


def q_distinct_predictions(spark, sf_dir):
    return q_explode_annotations(spark, sf_dir).select("prediction").distinct()


def q_map_class_labels(spark, sf_dir):
    return q_explode_annotations(spark, sf_dir).select(
        "event_id", map_class_labels("prediction", IMDB_CLASS_MAP).alias("prediction"))


def q_map_class_labels_second(spark, sf_dir):
    """The second sentiment head's class strings; an item without annotation stays as a NULL row."""
    words = {"pos": "positive", "neg": "negative", "neutral": "neutral"}
    spelled = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return annotations(spark, sf_dir).select("event_id", F.explode_outer("sentiment.result").alias("p")).select(
        "event_id", map_class_labels(spelled[F.col("p")], TWITTER_CLASS_MAP).alias("prediction"))


# --- tokens -----------------------------------------------------------------

def q_tokenize(spark, sf_dir):
    docs = documents(spark, sf_dir)
    toks = docs.select("doc_id", tokenize(clean_text("text")).alias("tokens"))
    return ts.token_stream(toks, "tokens", term_col="token")


def q_remove_stopwords(spark, sf_dir):
    w = _doc_words(spark, sf_dir)
    return w.select("doc_id", F.size("tokens").alias("n_tokens"), F.size("words").alias("n_words"))


def q_token_stream(spark, sf_dir):
    return ts.token_stream(_doc_words(spark, sf_dir), "words")


def q_filter_short_tokens(spark, sf_dir):
    w = _doc_words(spark, sf_dir)
    return ts.token_stream(w.select("doc_id", filter_short_tokens("words", 3).alias("kept")), "kept")


def q_ngrams_1(spark, sf_dir):
    w = _doc_words(spark, sf_dir)
    return ts.token_stream(w.select("doc_id", ngrams("words", 1).alias("grams")), "grams", term_col="gram")


def q_ngrams_2(spark, sf_dir):
    w = _doc_words(spark, sf_dir)
    return ts.token_stream(w.select("doc_id", ngrams("words", 2).alias("grams")), "grams", term_col="gram")


# --- counting ---------------------------------------------------------------

def q_term_frequency(spark, sf_dir):
    return ts.term_frequency(_doc_words(spark, sf_dir), "words")


def q_corpus_frequency(spark, sf_dir):
    return ts.corpus_frequency(_doc_words(spark, sf_dir), "words")


def q_document_frequency(spark, sf_dir):
    return ts.document_frequency(_doc_words(spark, sf_dir), "words")


def q_vocab_topk(spark, sf_dir):
    c = labelled_words(labelled_documents(spark, sf_dir)).where(F.col("split") == "train")
    return ts.vocabulary(c, "words", VOCAB_SIZE).select("term", F.col("idx").cast("int").alias("idx"), "cf")


def q_vocab_heavy_hitters(spark, sf_dir):
    """The most frequent words and bigrams of all documents, from sketches and a second, exact pass over the candidates."""
    path = scratch_path(spark, "heavy-words")  # cleaned and split once: each vocabulary reads them up to three times
    _doc_words(spark, sf_dir).select("words").write.parquet(path)
    words = spark.read.schema("words array<string>").parquet(path)
    parts = []
    for n, size in zip((1, 2), NGRAM_VOCAB_SIZES):
        grams = words.select((F.col("words") if n == 1 else ngrams("words", 2)).alias("grams"))
        parts.append(heavy_vocabulary(grams, "grams", size).table.select(F.lit(n).alias("n"), "term", F.col("idx").cast("int").alias("idx"), "cf"))
    return parts[0].unionByName(parts[1])


def _n_docs(spark, sf_dir):
    return ts.count_rows(drop_null_reviews(documents(spark, sf_dir), ["text"]))


def _idf(spark, sf_dir, min_df):
    return ts.idf_weights(_doc_words(spark, sf_dir), "words", _n_docs(spark, sf_dir), min_df)


def q_idf_weights(spark, sf_dir):
    return _idf(spark, sf_dir, 0).select("term", "df", _r("idf").alias("idf"))


def q_idf_weights_mindf(spark, sf_dir):
    return _idf(spark, sf_dir, 50).select("term", "df", _r("idf").alias("idf"))


def q_tfidf_long(spark, sf_dir):
    tf = ts.term_frequency(_doc_words(spark, sf_dir), "words")
    return ts.tfidf(tf, _idf(spark, sf_dir, 0)).select("doc_id", "term", "tf", _r("tfidf").alias("tfidf"))


def q_tfidf_bucketed(spark, sf_dir):
    """tf-idf from tables bucketed by term: the join moves no rows."""
    path = scratch_path(spark, "term-tables")
    store_terms(_doc_words(spark, sf_dir), "words", path).close()
    tables = open_terms(spark, path)
    out = tables.tfidf().select("doc_id", "term", "tf", _r("tfidf").alias("tfidf"))
    tables.close()   # the plan has the files; the session's catalog stays as it was
    return out


def q_count_vector_long(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    vocab = ts.vocabulary(c.where(F.col("split") == "train"), "words", VOCAB_SIZE)
    return ts.vocabulary_counts(c, "words", vocab, ["doc_id"]).select(
        "doc_id", F.col("idx").cast("int").alias("idx"), "tf")


def q_assemble_ngram_features(spark, sf_dir):
    f = ngram_tfidf_features(_corpus(spark, sf_dir))
    return f.train.unionByName(f.test).select(
        "doc_id", F.col("idx").cast("int").alias("idx"), _r("value").alias("value"))


# --- naive Bayes and evaluation ---------------------------------------------

def _nb(spark, sf_dir):
    return count_vector_nb(_corpus(spark, sf_dir), VOCAB_SIZE)


def q_nb_prior(spark, sf_dir):
    p = _nb(spark, sf_dir).prior
    return p.select("label", _r("pi").alias("pi"), _r("theta0").alias("theta0"))


def q_nb_model(spark, sf_dir):
    t = _nb(spark, sf_dir).theta
    return t.select("label", F.col("idx").cast("int").alias("idx"), _r("theta").alias("theta"))


def q_nb_predict(spark, sf_dir):
    p = _nb(spark, sf_dir).predictions
    return p.select("doc_id", "label", "prediction", _r("score").alias("score"))


def q_ngram_nb_predict(spark, sf_dir):
    p = ngram_tfidf_nb(_corpus(spark, sf_dir)).predictions
    return p.select("doc_id", "label", "prediction", _r("score").alias("score"))


def q_confusion_matrix(spark, sf_dir):
    return confusion_matrix(_nb(spark, sf_dir).predictions)


def q_eval_accuracy(spark, sf_dir):
    return evaluate(_nb(spark, sf_dir).predictions).select("n", _r("accuracy").alias("accuracy"))


def q_eval_f1_weighted(spark, sf_dir):
    return evaluate(_nb(spark, sf_dir).predictions).select("n", _r("f1").alias("f1"))


def q_nb_incremental(spark, sf_dir):
    """Naive Bayes from the statistics of a stream over the labelled documents, two files a micro-batch."""
    from revlens.streaming import train_files
    files = scratch_path(spark, "labelled-files")
    labelled = labelled_documents(spark, sf_dir)
    labelled.repartition(6, "doc_id").write.parquet(files)
    stats = train_files(spark, files, labelled.schema, scratch_path(spark, "nb-statistics"),
                        scratch_path(spark, "nb-train-checkpoint"), max_files_per_trigger=2)
    theta = nb_from_statistics(spark, stats, VOCAB_SIZE).theta
    return theta.select("label", F.col("idx").cast("int").alias("idx"), _r("theta").alias("theta"))


def q_nb_tables_predict(spark, sf_dir):
    """Naive Bayes saved as long tables, loaded and joined with the test documents."""
    corpus = _corpus(spark, sf_dir)
    path = scratch_path(spark, "nb-tables")
    save_nb(spark, path, count_vector_nb(corpus), VOCAB_SIZE)
    test = corpus.where(F.col("split") == "test").select("doc_id", "label", "words")
    out = score_nb_tables(load_tables(spark, path), test)
    return out.select("doc_id", "label", "prediction", _r("score").alias("score"))


def q_write_with_metrics(spark, sf_dir):
    """Accuracy and F1 counted by the job that writes the predictions."""
    preds = _nb(spark, sf_dir).predictions
    classes = [float(c) for c in range(2)]
    report = write_with_metrics(preds, scratch_path(spark, "observed-predictions"), {"nb": "prediction"}, classes)
    return report.select("model", "n", _r("accuracy").alias("accuracy"), _r("f1").alias("f1"))


def q_committed_predictions(spark, sf_dir):
    """Predictions written as one commit and read back by its file list."""
    path = scratch_path(spark, "committed-predictions")
    write_committed(_nb(spark, sf_dir).predictions, path)
    return read_committed(spark, path).select("doc_id", "label", "prediction", _r("score").alias("score"))


# --- file sources -------------------------------------------------------------

def q_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "reviews-csv")
    write_reviews_csv(drop_null_reviews(reviews(spark, sf_dir)), path)
    return read_reviews_csv(spark, path)


def q_text_scan(spark, sf_dir):
    path = scratch_path(spark, "reviews-text")
    documents(spark, sf_dir, ["text"]).write.mode("overwrite").text(path)
    return read_lines(spark, path, "line")


SPARK_QUERIES = {
    "clean_text": q_clean_text,
    "drop_null_reviews": q_drop_null_reviews,
    "binarize_score": q_binarize_score,
    "hash_split": q_hash_split,
    "label_balance": q_label_balance,
    "explode_annotations": q_explode_annotations,
    "distinct_predictions": q_distinct_predictions,
    "map_class_labels": q_map_class_labels,
    "map_class_labels_second": q_map_class_labels_second,
    "tokenize": q_tokenize,
    "remove_stopwords": q_remove_stopwords,
    "token_stream": q_token_stream,
    "filter_short_tokens": q_filter_short_tokens,
    "ngrams_1": q_ngrams_1,
    "ngrams_2": q_ngrams_2,
    "term_frequency": q_term_frequency,
    "corpus_frequency": q_corpus_frequency,
    "document_frequency": q_document_frequency,
    "vocab_topk": q_vocab_topk,
    "vocab_heavy_hitters": q_vocab_heavy_hitters,
    "idf_weights": q_idf_weights,
    "idf_weights_mindf": q_idf_weights_mindf,
    "tfidf_long": q_tfidf_long,
    "tfidf_bucketed": q_tfidf_bucketed,
    "count_vector_long": q_count_vector_long,
    "assemble_ngram_features": q_assemble_ngram_features,
    "nb_prior": q_nb_prior,
    "nb_model": q_nb_model,
    "nb_predict": q_nb_predict,
    "ngram_nb_predict": q_ngram_nb_predict,
    "confusion_matrix": q_confusion_matrix,
    "eval_accuracy": q_eval_accuracy,
    "eval_f1_weighted": q_eval_f1_weighted,
    "nb_incremental": q_nb_incremental,
    "nb_tables_predict": q_nb_tables_predict,
    "write_with_metrics": q_write_with_metrics,
    "committed_predictions": q_committed_predictions,
    "csv_roundtrip": q_csv_roundtrip,
    "text_scan": q_text_scan,
}
