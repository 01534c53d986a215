"""MLlib pipelines for the reference's three extractors and three classifiers.

Every pipeline starts with the same preparation stages (cleaning is a stage
too, so scoring applies exactly what training applied).  Fitting runs in
three phases so each pass of an iterative solver reads cached features
instead of re-tokenizing the corpus: preparation output is kept, feature
stages are fit and their output kept, classifiers are fit on that, and the
fitted stages are joined into one ``PipelineModel``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.feature import (
    IDF, CountVectorizer, HashingTF, NGram, SQLTransformer, StopWordsRemover, Tokenizer,
    VectorAssembler,
)
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.stopwords import ENGLISH_STOP_WORDS
from revlens.functions.text import KEEP_PATTERN, filter_short_tokens
from revlens.operators.stem import stem_tokens
from revlens.operators.termstats import corpus_frequency
from revlens.operators.word2vec import WordVectors, fit_word2vec
from revlens.plans.relational import NGRAM_MIN_DOC_FREQ, NGRAM_VOCAB_SIZES
from revlens.session import keep, scratch_path

# Model settings of the reference.
HASHING_FEATURES = 1000
NB_PARAMS = {"smoothing": 1.0, "modelType": "multinomial"}
LR_PARAMS = {"maxIter": 1000, "regParam": 0.01, "elasticNetParam": 0.01}
LR_L2_PARAMS = {"maxIter": 1000, "regParam": 0.01}
SVM_PARAMS = {"maxIter": 1000, "regParam": 0.01}
W2V_PARAMS = {"vectorSize": 100, "minCount": 0, "maxIter": 5}
#: MLlib's names of Word2Vec's settings and those of ``fit_word2vec``.
W2V_NAMES = {"vectorSize": "vector_size", "minCount": "min_count", "maxIter": "iterations", "stepSize": "step",
             "windowSize": "window", "maxSentenceLength": "sentence_words", "seed": "seed"}
MIN_TOKEN_LENGTH = 3
#: Partitions Word2Vec trains on at least.  Their rows are averaged every iteration, so the model
#: depends on the number: it follows from the corpus and is not taken from the cluster.
W2V_PARTITIONS = 8

#: Bytes of features a task reads in every iteration of a solver.
ROUND_PARTITION_BYTES = 64 << 20

CLASSIFIER_PREFIX = {"nb": "NB", "lr": "LR", "svm": "SVM"}


def prediction_col(classifier: str) -> str:
    return f"{CLASSIFIER_PREFIX[classifier]}_prediction"


def prepare_stages(text_col: str = "text", stop_words=None) -> list:
    """clean -> tokens -> words (Spark ML Tokenizer and StopWordsRemover);
    ``stop_words`` replaces Spark's English list.  A NULL text counts as empty,
    so scoring never fails on one; any column name works."""
    name = "`" + text_col.replace("`", "``") + "`"
    pattern = KEEP_PATTERN.replace("\\", "\\\\")
    clean = SQLTransformer(statement=(
        f"SELECT *, lower(array_join(regexp_extract_all(coalesce({name}, ''), '{pattern}', 0), '')) "
        "AS clean_text FROM __THIS__"))
    return [clean,
            Tokenizer(inputCol="clean_text", outputCol="tokens"),
            StopWordsRemover(inputCol="tokens", outputCol="words",
                             stopWords=list(ENGLISH_STOP_WORDS if stop_words is None else stop_words))]


def classifier_stages(features_col: str, label_col: str = "label", which=("nb", "lr", "svm"),
                      lr_params: dict | None = None, svm_params: dict | None = None,
                      nb_params: dict | None = None) -> list:
    stages = []
    for name in which:
        p = CLASSIFIER_PREFIX[name]
        common = {"featuresCol": features_col, "labelCol": label_col,
                  "predictionCol": f"{p}_prediction", "rawPredictionCol": f"{p}_rawPrediction"}
        if name == "nb":
            stages.append(NaiveBayes(probabilityCol=f"{p}_probability", **common,
                                     **(nb_params or NB_PARAMS)))
        elif name == "lr":
            stages.append(LogisticRegression(probabilityCol=f"{p}_probability", **common,
                                             **(lr_params or LR_PARAMS)))
        elif name == "svm":
            stages.append(LinearSVC(**common, **(svm_params or SVM_PARAMS)))
        else:
            raise ValueError(f"unknown classifier {name!r}")
    return stages


def tfidf_stages(num_features: int = HASHING_FEATURES, input_col: str = "words") -> tuple[list, str]:
    return [HashingTF(inputCol=input_col, outputCol="tf", numFeatures=num_features),
            IDF(inputCol="tf", outputCol="tfidf")], "tfidf"


def ngram_stages(orders=(1, 2), vocab_sizes=NGRAM_VOCAB_SIZES,
                 min_doc_freqs=NGRAM_MIN_DOC_FREQ, input_col: str = "words") -> tuple[list, str]:
    stages = []
    for n in orders:
        stages += [NGram(n=n, inputCol=input_col, outputCol=f"{n}_grams"),
                   CountVectorizer(vocabSize=vocab_sizes[n - 1], inputCol=f"{n}_grams",
                                   outputCol=f"{n}_tf"),
                   IDF(inputCol=f"{n}_tf", outputCol=f"{n}_tfidf", minDocFreq=min_doc_freqs[n - 1])]
    stages.append(VectorAssembler(inputCols=[f"{n}_tfidf" for n in orders], outputCol="features"))
    return stages, "features"


@dataclass
class FittedPipeline:
    """A fitted pipeline.  For word2vec, ``prepare`` holds the preparation
    stages: stemming is a distributed job between preparation and the model,
    not a row-wise stage.  ``vectors`` are its words' vectors, a table that is
    joined, and ``model`` holds the classifiers."""
    model: PipelineModel
    features_col: str
    classifiers: tuple = field(default_factory=tuple)
    prepare: PipelineModel | None = None
    id_col: str = "doc_id"
    vectors: WordVectors | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        if self.prepare is not None:
            df = stem_tokens(self.prepare.transform(df), "words", "stems")
        if self.vectors is not None:
            df = df.withColumn("w2v_words", filter_short_tokens("stems", MIN_TOKEN_LENGTH))
            df = self.vectors.transform(df, "w2v_words", self.features_col)
        return self.model.transform(df)


def fit_text_pipeline(train: DataFrame, feature_stages: list, features_col: str,
                      classifiers=("nb", "lr", "svm"), label_col: str = "label",
                      text_col: str = "text", pre_stages: list | None = None,
                      lr_params=None, svm_params=None, nb_params=None) -> FittedPipeline:
    """prepare -> features -> classifiers, fit in phases over cached data."""
    pre = PipelineModel(stages=prepare_stages(text_col) if pre_stages is None else pre_stages)
    prepared = pre.transform(train) if pre.stages else train
    # cache only what the feature stages can read (not the raw and cleaned text)
    prepared = keep(prepared.drop(*[c for c in (text_col, "clean_text", "tokens")
                                   if c in prepared.columns and c != label_col]))
    feat_model = Pipeline(stages=feature_stages).fit(prepared)
    feats = sized_for_rounds(feat_model.transform(prepared).select(features_col, label_col), features_col)
    estimators = classifier_stages(features_col, label_col, classifiers, lr_params, svm_params, nb_params)
    models = fit_concurrently(estimators, feats)
    feats.unpersist()
    prepared.unpersist()
    return FittedPipeline(PipelineModel(stages=pre.stages + feat_model.stages + models),
                          features_col, tuple(classifiers))


def sized_for_rounds(features: DataFrame, features_col: str, target_bytes: int = ROUND_PARTITION_BYTES) -> DataFrame:
    """Cached features in partitions of about ``target_bytes`` each.

    An iterative solver starts one task per partition and iteration, up to a
    thousand times, so partitions sized for reading text (whose features are
    far smaller) cost mostly task starts, and every task is sent the plan it
    descends from.  So the features are written once to the shared folder,
    which also cuts their lineage, and read back merged, without a shuffle, to
    as many partitions as their bytes need (12 a non-zero value, 40 a row); a
    corpus whose features fill its partitions keeps them.  Only the placement
    of rows changes.
    """
    spark = features.sparkSession
    path = scratch_path(spark, "features")
    features.write.parquet(path)
    table = spark.read.schema(features.schema).parquet(path)
    if not table.take(1):
        return keep(table.coalesce(1), eager=True)
    stats = table.select(Summarizer.metrics("numNonZeros", "count").summary(F.col(features_col)).alias("s")) \
        .select("s.numNonZeros", "s.count").first()
    size = 12 * float(stats["numNonZeros"].toArray().sum()) + 40 * stats["count"]
    return keep(table.coalesce(max(1, math.ceil(size / target_bytes))), eager=True)


def fit_concurrently(estimators: list, data: DataFrame) -> list:
    """Fit independent estimators on the same (cached) data as concurrent
    Spark jobs -- the thread-pool pattern of PySpark's own CrossValidator.

    The classifiers read the same feature column and write distinct output
    columns, so each model equals the one a sequential ``Pipeline`` fit gives;
    their per-iteration jobs interleave on task slots the others leave idle.
    """
    return concurrently(data.sparkSession, lambda est: est.fit(data), estimators)


def concurrently(spark: SparkSession, call, items) -> list:
    """``call`` of every item, each in a thread of its own with the session's properties."""
    items = list(items)
    if len(items) <= 1:
        return [call(x) for x in items]
    from multiprocessing.pool import ThreadPool

    from pyspark.util import inheritable_thread_target
    pool = ThreadPool(len(items))
    try:
        return pool.map(inheritable_thread_target(spark)(call), items)
    finally:
        pool.close()


def fit_word2vec_pipeline(train: DataFrame, classifiers=("svm", "lr"), label_col: str = "label",
                          text_col: str = "text", id_col: str = "doc_id",
                          num_partitions: int = W2V_PARTITIONS, w2v_params: dict | None = None,
                          lr_params=None, svm_params=None,
                          max_vocabulary: int | None = None) -> FittedPipeline:
    """prepare -> stem -> length filter -> Word2Vec -> LR (L2) / SVM.

    The reference keeps every word (``minCount=0``), so vocabulary and vectors
    are tables (``operators.word2vec``).  ``max_vocabulary`` bounds the words:
    their distributed counts give the smallest ``minCount`` that leaves at most so many.
    """
    pre = PipelineModel(stages=prepare_stages(text_col))
    stemmed = stem_tokens(pre.transform(train).select(id_col, label_col, "words"), "words", "stems")
    prepared = keep(stemmed.select(label_col, filter_short_tokens("stems", MIN_TOKEN_LENGTH).alias("w2v_words")))
    p = dict(w2v_params or W2V_PARAMS)
    if max_vocabulary is not None:
        p["minCount"] = min_count_for(prepared, "w2v_words", max_vocabulary)
    vectors = fit_word2vec(prepared, "w2v_words", partitions=num_partitions,
                           **{W2V_NAMES[name]: value for name, value in p.items()})
    col = "word2vec"
    feats = sized_for_rounds(vectors.transform(prepared, "w2v_words", col).select(col, label_col), col)
    models = fit_concurrently(classifier_stages(col, label_col, classifiers, lr_params or LR_L2_PARAMS, svm_params), feats)
    feats.unpersist()
    prepared.unpersist()
    return FittedPipeline(PipelineModel(stages=models), col, tuple(classifiers), pre, id_col, vectors)


def min_count_for(df: DataFrame, tokens_col: str, size: int) -> int:
    """Smallest word count that at most ``size`` words reach (0: all words fit)."""
    first_out = (corpus_frequency(df, tokens_col).orderBy(F.desc("cf")).offset(size).limit(1)
                 .select("cf").collect())
    return int(first_out[0]["cf"]) + 1 if first_out else 0


EXTRACTOR_CLASSIFIERS = {"tfidf": ("nb", "lr", "svm"), "ngram": ("nb", "lr", "svm"),
                         "word2vec": ("svm", "lr")}


def fit_extractor(train: DataFrame, extractor: str, classifiers=None, stem: bool | None = None,
                  label_col: str = "label", id_col: str = "doc_id", **params) -> FittedPipeline:
    """One entry point for the three extractors.  ``stem`` (default: only for
    word2vec, as in the reference) runs the distributed stemming job between
    preparation and the feature stages."""
    if extractor not in EXTRACTOR_CLASSIFIERS:
        raise ValueError(f"extractor must be one of {sorted(EXTRACTOR_CLASSIFIERS)}")
    classifiers = tuple(classifiers or EXTRACTOR_CLASSIFIERS[extractor])
    if extractor == "word2vec" and "nb" in classifiers:
        raise ValueError("naive Bayes needs non-negative features; word2vec vectors are signed")
    if extractor == "word2vec":
        return fit_word2vec_pipeline(train, classifiers, label_col, id_col=id_col, **params)
    if not stem:
        stages, col = tfidf_stages() if extractor == "tfidf" else ngram_stages()
        return fit_text_pipeline(train, stages, col, classifiers, label_col, **params)
    pre = PipelineModel(stages=prepare_stages())
    stemmed = stem_tokens(pre.transform(train).select(id_col, label_col, "words"), "words", "stems")
    stages, col = (tfidf_stages(input_col="stems") if extractor == "tfidf"
                   else ngram_stages(input_col="stems"))
    fitted = fit_text_pipeline(stemmed, stages, col, classifiers, label_col, pre_stages=[], **params)
    return FittedPipeline(fitted.model, col, fitted.classifiers, pre, id_col)


def score(df: DataFrame, fitted: FittedPipeline | PipelineModel, classifier: str,
          id_col: str = "doc_id", classifiers=None) -> DataFrame:
    """``(id, prediction)`` from the chosen classifier in one transform; the choice
    is checked before any job starts.  ``id_col`` may list several columns to carry."""
    if classifier not in CLASSIFIER_PREFIX:
        raise ValueError(f"classifier must be one of {sorted(CLASSIFIER_PREFIX)}")
    model = fitted.model if isinstance(fitted, FittedPipeline) else fitted
    available = fitted.classifiers if isinstance(fitted, FittedPipeline) else classifiers
    if available is not None and classifier not in available:
        raise ValueError(f"this model has no {classifier!r} classifier (has {list(available)})")
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    out = fitted.transform(df) if isinstance(fitted, FittedPipeline) else model.transform(df)
    return out.select(*ids, F.col(prediction_col(classifier)).alias("prediction"))
