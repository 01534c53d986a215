"""Front half of every job: clean text, drop incomplete rows, binarize, split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from revlens.functions.labels import binarize_score
from revlens.functions.text import clean_text, split_label, tokenize, remove_stopwords


def drop_null_reviews(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any of ``cols`` (all columns by default).

    Same rows as ``dropna()``, written as ``IS NOT NULL`` conjuncts: those reach
    the Parquet reader as pushed filters, ``dropna``'s ``atleastnnonnulls`` does not.
    """
    cond = None
    for c in cols or df.columns:
        term = F.col(c).isNotNull()
        cond = term if cond is None else cond & term
    return df if cond is None else df.where(cond)


def binarize(df: DataFrame, score_col: str = "score", out_col: str | None = None) -> DataFrame:
    """1..3 -> 0, 4..5 -> 1 on a numeric column; a string column is left as is
    (the value-replace of the reference only touches numeric columns)."""
    out_col = out_col or score_col
    if not isinstance(df.schema[score_col].dataType, NumericType):
        return df if out_col == score_col else df.withColumn(out_col, F.col(score_col))
    return df.withColumn(out_col, binarize_score(score_col))


def split_valid_scores(df: DataFrame, score_col: str = "score",
                       valid=(1, 2, 3, 4, 5)) -> tuple[DataFrame, DataFrame]:
    """(rows with a rating in ``valid``, the other rows) -- out-of-range or NULL
    ratings go to a reject DataFrame instead of failing the classifier fit."""
    ok = F.col(score_col).isin(*valid)
    return df.where(ok), df.where(~F.coalesce(ok, F.lit(False)))


def prepare(df: DataFrame, text_col: str = "text", score_col: str | None = "score",
            keep: list[str] | None = None) -> DataFrame:
    """Select, drop NULLs, clean, binarize.

    NULLs are dropped before cleaning (cleaning maps non-NULL to non-NULL, so
    the result is the same) which lets the IS NOT NULL filter reach the scan.
    """
    keep = keep or []
    cols = keep + ([score_col] if score_col else []) + [text_col]
    out = drop_null_reviews(df.select(*cols), [c for c in cols if c not in keep])
    out = out.withColumn(text_col, clean_text(text_col))
    return binarize(out, score_col) if score_col else out


def add_words(df: DataFrame, text_col: str = "text", tokens_col: str = "tokens",
              words_col: str = "words", stop_words=None) -> DataFrame:
    """Tokenize (ML Tokenizer semantics) and remove stop words, natively."""
    out = df.withColumn(tokens_col, tokenize(text_col))
    if stop_words is None:
        return out.withColumn(words_col, remove_stopwords(tokens_col))
    return out.withColumn(words_col, remove_stopwords(tokens_col, stop_words))


def with_split(df: DataFrame, id_col: str = "doc_id", split_col: str = "split",
               modulus: int = 10, test_buckets: int = 1) -> DataFrame:
    """Tag each row 'train' / 'test' from a hash of its id (default 90/10)."""
    return df.withColumn(split_col, split_label(id_col, modulus, test_buckets))


def hash_split(df: DataFrame, id_col: str = "doc_id", modulus: int = 10,
               test_buckets: int = 1) -> tuple[DataFrame, DataFrame]:
    """(train, test) by id hash: stable under repartitioning and column changes."""
    tagged = with_split(df, id_col, "_split", modulus, test_buckets)
    return (tagged.where(F.col("_split") == "train").drop("_split"),
            tagged.where(F.col("_split") == "test").drop("_split"))


def random_split(df: DataFrame, weights=(0.9, 0.1), seed: int = 42) -> list[DataFrame]:
    """The reference's Bernoulli split, kept as an option (depends on row order)."""
    return df.randomSplit(list(weights), seed=seed)


def label_balance(df: DataFrame, label_col: str = "label", split_col: str = "split") -> DataFrame:
    """Rows per (split, label)."""
    return df.groupBy(split_col, label_col).agg(F.count(F.lit(1)).alias("n"))
