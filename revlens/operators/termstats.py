"""Long-form term statistics: the counting that happens inside HashingTF,
CountVectorizer and IDF, as ``(doc, term, value)`` DataFrame jobs.

Long form keeps the vocabulary distributed (no driver-side arrays), gives
exact SQL oracles, and lets partial aggregation collapse hot terms map-side
before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.operators.skew import DEFAULT_HOT_KEYS, hot_cold_join, top_keys
from revlens.session import scratch_path


def explode_with_pos(df: DataFrame, array_col: str, keep: list[str], pos_col: str = "pos",
                     value_col: str = "term") -> DataFrame:
    """``posexplode`` (one row per element, empty or NULL arrays give no row).

    Written as the outer variant plus ``pos IS NOT NULL`` -- the same rows,
    because a real element always has a position.  For the plain generator
    Catalyst infers ``size(array) > 0`` and pushes it below the exchange,
    where it re-evaluates the whole clean/tokenize expression a second time.
    """
    return (df.select(*keep, F.posexplode_outer(array_col).alias(pos_col, value_col))
            .where(F.col(pos_col).isNotNull()))


def token_stream(df: DataFrame, tokens_col: str, id_col: str = "doc_id",
                 term_col: str = "term", carry: list[str] | None = None) -> DataFrame:
    """One row per token with its 0-based position (empty arrays give no row)."""
    return explode_with_pos(df, tokens_col, [id_col, *(carry or [])], "pos", term_col)


def term_frequency(df: DataFrame, tokens_col: str, id_col: str = "doc_id",
                   carry: list[str] | None = None, term_col: str = "term") -> DataFrame:
    """``(doc, [carry...], term, tf)``.  All tokens of a document sit in one row,
    so the partial aggregate collapses repeats inside each task before the shuffle."""
    carry = carry or []
    return (explode_with_pos(df, tokens_col, [id_col, *carry], "_pos", term_col)
            .groupBy(id_col, *carry, term_col)
            .agg(F.count(F.lit(1)).alias("tf")))


def corpus_frequency(df: DataFrame, tokens_col: str, term_col: str = "term") -> DataFrame:
    """``(term, cf)``: total occurrences in the corpus, counted straight from the
    token arrays -- one exchange of per-task sums, whatever the input's layout."""
    return (explode_with_pos(df, tokens_col, [], "_pos", term_col)
            .groupBy(term_col).agg(F.count(F.lit(1)).alias("cf")))


def document_frequency(df: DataFrame, tokens_col: str, term_col: str = "term") -> DataFrame:
    """``(term, df)``: documents containing the term (each array's distinct tokens, one exchange)."""
    once = df.select(F.array_distinct(tokens_col).alias("_once"))
    return (explode_with_pos(once, "_once", [], "_pos", term_col)
            .groupBy(term_col).agg(F.count(F.lit(1)).alias("df")))


def vocabulary(df: DataFrame, tokens_col: str, size: int, term_col: str = "term") -> DataFrame:
    """Top ``size`` terms by corpus count, ties by term: ``(term, idx, cf)``.

    ``orderBy().limit()`` runs as a per-task top-k merged on one task, so at most
    ``size`` rows per task ever move; the index is numbered on those ``size`` rows.
    """
    top = corpus_frequency(df, tokens_col, term_col).orderBy(F.desc("cf"), F.asc(term_col)).limit(size)
    w = Window.orderBy(F.desc("cf"), F.asc(term_col))
    return top.select(term_col, (F.row_number().over(w) - 1).alias("idx"), "cf")


def count_rows(df: DataFrame) -> Column:
    """Row count as a scalar-subquery column (no join, no collect)."""
    return df.select(F.count(F.lit(1))).scalar()


def idf_weights(df: DataFrame, tokens_col: str, n_docs: Column, min_doc_freq: int = 0,
                term_col: str = "term") -> DataFrame:
    """``(term, df, idf)`` with idf = ln((m + 1) / (df + 1)), 0 when df < min_doc_freq."""
    return with_idf(document_frequency(df, tokens_col, term_col), n_docs, min_doc_freq)


def with_idf(dfreq: DataFrame, n_docs: Column, min_doc_freq: int = 0) -> DataFrame:
    """Adds ``idf`` to document frequencies ``df``."""
    m = n_docs.cast("double")
    idf = F.when(F.col("df") >= min_doc_freq,
                 F.log((m + F.lit(1.0)) / (F.col("df") + F.lit(1.0)))).otherwise(F.lit(0.0))
    return dfreq.withColumn("idf", idf)


def tfidf(tf: DataFrame, idf: DataFrame, term_col: str = "term", bounded: bool = False,
          hot_keys: int = DEFAULT_HOT_KEYS) -> DataFrame:
    """``tf`` rows scaled by the term's idf (terms without an idf row are dropped).

    ``bounded=True`` means ``idf`` is limited by construction (a top-k vocabulary
    or a fixed hash space) and is broadcast.  Otherwise the idf table grows with
    the corpus: the rows of the ``hot_keys`` terms with the highest document
    frequency (exactly the number of tf rows per term) meet their weights by
    broadcast, the others by a sort-merge join.  Four branches of that join
    read the weights, so they are written once and not counted in each.
    """
    weights = idf.select(term_col, "df", "idf")
    if bounded:
        joined = tf.join(F.broadcast(weights), term_col)
    else:
        path = scratch_path(weights.sparkSession, "term-weights")
        weights.write.parquet(path)
        weights = weights.sparkSession.read.schema(weights.schema).parquet(path)
        joined = hot_cold_join(tf, weights, term_col, top_keys(weights, term_col, "df", hot_keys))
    return joined.withColumn("tfidf", F.col("tf") * F.col("idf"))


def restrict_to_vocabulary(tf: DataFrame, vocab: DataFrame, term_col: str = "term") -> DataFrame:
    """CountVectorizer transform in long form: ``tf`` rows of vocabulary terms,
    with the vocabulary index.  The vocabulary is at most its requested size,
    so it is broadcast."""
    return tf.join(F.broadcast(vocab.select(term_col, "idx")), term_col)


def vocabulary_counts(df: DataFrame, tokens_col: str, vocab: DataFrame, keep: list[str],
                      term_col: str = "term") -> DataFrame:
    """``([keep...], idx, tf)``: counts of vocabulary terms per row group of ``keep``.

    Tokens outside the vocabulary (bounded, broadcast) go before the
    aggregation, so only vocabulary rows are shuffled.
    """
    tokens = explode_with_pos(df, tokens_col, keep, "_pos", term_col)
    return (tokens.join(F.broadcast(vocab.select(term_col, "idx")), term_col)
            .groupBy(*keep, "idx").agg(F.count(F.lit(1)).alias("tf")))


def feature_idf(counts: DataFrame, n_docs: Column, min_doc_freq: int = 0,
                feature_col: str = "idx") -> DataFrame:
    """IDF fit on vocabulary-restricted counts (one row per document and feature): ``(idx, df, idf)``."""
    return with_idf(counts.groupBy(feature_col).agg(F.count(F.lit(1)).alias("df")), n_docs, min_doc_freq)


def scale_features(counts: DataFrame, idf: DataFrame, feature_col: str = "idx") -> DataFrame:
    """IDF transform on vocabulary-restricted counts (idf table is vocabulary-bounded)."""
    return (counts.join(F.broadcast(idf.select(feature_col, "idf")), feature_col)
            .withColumn("value", F.col("tf") * F.col("idf")))


def assemble(parts: list[tuple[DataFrame, Column | int]], feature_col: str = "idx",
             value_col: str = "value", id_cols: list[str] | None = None) -> DataFrame:
    """VectorAssembler in long form: union of feature blocks, each shifted by
    the total size of the blocks before it (``(block, size)`` pairs)."""
    id_cols = id_cols or ["doc_id"]
    out = None
    offset: Column = F.lit(0).cast("bigint")
    for block, size in parts:
        shifted = block.select(*id_cols, (F.col(feature_col) + offset).alias(feature_col), value_col)
        out = shifted if out is None else out.unionByName(shifted)
        offset = offset + (size if isinstance(size, Column) else F.lit(size))
    return out
