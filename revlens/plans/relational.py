"""Relational text-classification jobs: the reference's count-vector +
naive Bayes path (and its n-gram / IDF variant) as DataFrame jobs whose
every number can be checked against SQL.

Shape of the plan: documents are read once, prepared once and kept; term
counts are one partial-then-final aggregation; everything that is joined back
onto the counts (vocabulary, idf, naive Bayes parameters) is bounded by the
vocabulary size and broadcast; per-document outputs aggregate on ``doc_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.text import ngrams
from revlens.operators import termstats as ts
from revlens.operators.evaluate import evaluate
from revlens.operators.naive_bayes import fit_nb, score_nb
from revlens.operators.prepare import add_words, drop_null_reviews, prepare, with_split
from revlens.session import keep

# N-gram settings of the reference (vocabulary size and minimum
# document frequency for n = 1, 2, 3).
NGRAM_VOCAB_SIZES = (8192, 4096, 1024)
NGRAM_MIN_DOC_FREQ = (50, 5, 5)
#: Vocabulary of the count-vector jobs: that of the reference's single words.
VOCAB_SIZE = NGRAM_VOCAB_SIZES[0]


def labelled_words(labelled: DataFrame, stop_words=None, keep_tokens: bool = False) -> DataFrame:
    """``(doc_id, label, split, words[, tokens])``: cleaned, tokenized, stop words
    removed, hash split."""
    # rows without a label or a text are dropped, as the reference's dropna() does
    complete = drop_null_reviews(labelled, ["label", "text"])
    prepared = prepare(complete, text_col="text", score_col=None, keep=["doc_id", "label"])
    cols = ["doc_id", "label", "split", "words"] + (["tokens"] if keep_tokens else [])
    return with_split(add_words(prepared, stop_words=stop_words)).select(*cols)


def build_corpus(labelled: DataFrame, stop_words=None, keep_tokens: bool = False) -> DataFrame:
    """``labelled_words``, kept: for jobs with several branches that read it.  The
    text itself (and by default the pre-stop-word tokens) is not kept."""
    return keep(labelled_words(labelled, stop_words, keep_tokens), eager=True)


@dataclass
class NBResult:
    predictions: DataFrame   # doc_id, label, prediction, score
    prior: DataFrame         # label, pi, theta0
    theta: DataFrame         # label, idx, theta
    vocab: DataFrame         # term, idx, cf


def count_vector_nb(corpus: DataFrame, vocab_size: int = VOCAB_SIZE, smoothing: float = 1.0,
                    words_col: str = "words") -> NBResult:
    """Top-``vocab_size`` count vectors fit on the train split, naive Bayes on
    raw counts, scored on the test split."""
    train = corpus.where(F.col("split") == "train")
    test = corpus.where(F.col("split") == "test")
    vocab = keep(ts.vocabulary(train, words_col, vocab_size))
    feats = ts.vocabulary_counts(train, words_col, vocab, ["doc_id", "label"]).withColumnRenamed("tf", "value")
    prior, theta = fit_nb(feats, train.select("doc_id", "label"), ts.count_rows(vocab), smoothing)
    test_feats = ts.vocabulary_counts(test, words_col, vocab, ["doc_id"]).withColumnRenamed("tf", "value")
    out = score_nb(test_feats, test.select("doc_id", "label"), prior, theta, max_features=vocab_size)
    return NBResult(out.select("doc_id", "label", "prediction", "score"), prior, theta, vocab)


@dataclass
class NgramFeatures:
    train: DataFrame     # doc_id, label, idx, value  (assembled 1..n-gram tf-idf)
    test: DataFrame      # doc_id, label, idx, value
    size: object         # Column: total feature-space size
    blocks: list         # per n: (vocab, idf)


def ngram_tfidf_features(corpus: DataFrame, orders=(1, 2), vocab_sizes=NGRAM_VOCAB_SIZES,
                         min_doc_freqs=NGRAM_MIN_DOC_FREQ, words_col: str = "words") -> NgramFeatures:
    """For each n: n-grams -> top-V vocabulary and IDF(minDocFreq) fit on the
    train split -> tf-idf; blocks assembled with offsets (n-gram features
    after the (n-1)-gram ones)."""
    train = corpus.where(F.col("split") == "train")
    n_train = ts.count_rows(train)
    parts_train, parts_test, blocks = [], [], []
    for n in orders:
        grams = corpus.select("doc_id", "label", "split", ngrams(words_col, n).alias("grams"))
        vocab = keep(ts.vocabulary(grams.where(F.col("split") == "train"), "grams", vocab_sizes[n - 1]))
        counts = keep(ts.vocabulary_counts(grams, "grams", vocab, ["doc_id", "label", "split"]))
        idf = keep(ts.feature_idf(counts.where(F.col("split") == "train"), n_train,
                                  min_doc_freqs[n - 1]))
        scaled = ts.scale_features(counts, idf)
        size = ts.count_rows(vocab)
        parts_train.append((scaled.where(F.col("split") == "train"), size))
        parts_test.append((scaled.where(F.col("split") == "test"), size))
        blocks.append((vocab, idf))
    ids = ["doc_id", "label"]
    total = None
    for _, size in parts_train:
        total = size if total is None else total + size
    return NgramFeatures(ts.assemble(parts_train, id_cols=ids), ts.assemble(parts_test, id_cols=ids),
                         total, blocks)


def ngram_tfidf_nb(corpus: DataFrame, orders=(1, 2), smoothing: float = 1.0) -> NBResult:
    """The reference's n-gram extractor + naive Bayes, relational end to end."""
    feats = ngram_tfidf_features(corpus, orders)
    train_docs = corpus.where(F.col("split") == "train").select("doc_id", "label")
    test_docs = corpus.where(F.col("split") == "test").select("doc_id", "label")
    prior, theta = fit_nb(feats.train, train_docs, feats.size, smoothing)
    out = score_nb(feats.test, test_docs, prior, theta,
                   max_features=sum(NGRAM_VOCAB_SIZES[n - 1] for n in orders)).select("doc_id", "label", "prediction", "score")
    return NBResult(out, prior, theta, feats.blocks[0][0])


def classify_and_evaluate(labelled: DataFrame, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """Flagship: count-vector naive Bayes -> accuracy, weighted F1, n."""
    return evaluate(count_vector_nb(build_corpus(labelled), vocab_size).predictions)
