"""Text functions against the micro-fixtures (FIXTURES.md section 4)."""

import pytest
from pyspark.ml.feature import NGram, StopWordsRemover, Tokenizer
from pyspark.sql import functions as F

from revlens.functions import (
    ENGLISH_STOP_WORDS, clean_text, filter_short_tokens, ngrams, remove_stopwords, tokenize,
)

TOKENIZER_CASES = [
    ("  a  b\n\tc ", ["", "", "a", "", "b", "", "c"]),
    ("", [""]),
    ("   ", []),
    ("Foo bar", ["foo", "bar"]),
]


def test_tokenize_fixtures(spark):
    df = spark.createDataFrame([(t,) for t, _ in TOKENIZER_CASES], "text string")
    got = [r.t for r in df.select(tokenize("text").alias("t")).collect()]
    assert got == [want for _, want in TOKENIZER_CASES]


def test_tokenize_equals_ml_tokenizer(spark):
    texts = [t for t, _ in TOKENIZER_CASES] + ["a\n", "\nx", "x  y\t\t", "UPPER lower"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    ml = Tokenizer(inputCol="text", outputCol="ml").transform(df)
    rows = ml.select("ml", tokenize("text").alias("native")).collect()
    assert all(r.ml == r.native for r in rows)


def test_clean_text_fuses_neighbours(spark):
    df = spark.createDataFrame([("books.Alan Lee's 2nd é",)], "text string")
    assert df.select(clean_text("text")).first()[0] == "booksalan lees nd "


def test_stop_words_case_insensitive_keeps_order(spark):
    df = spark.createDataFrame([(["isnt", "isn't", "THE", "x", ""],)], "t array<string>")
    got = df.select(remove_stopwords("t", ["isn't", "The"])).first()[0]
    assert got == ["isnt", "x", ""]


def test_stop_word_list_is_sparks(spark):
    assert list(ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_stop_words_equal_ml_remover(spark):
    df = spark.createDataFrame([(["the", "book", "was", "", "great", "i'm", "The"],)], "t array<string>")
    ml = StopWordsRemover(inputCol="t", outputCol="ml").transform(df)
    r = ml.select("ml", remove_stopwords("t").alias("native")).first()
    assert r.ml == r.native


@pytest.mark.parametrize("tokens,want", [
    (["a"], []), (["a", "b", "c"], ["a b", "b c"]), ([], []), (["a", "", "b"], ["a ", " b"]),
])
def test_bigrams(spark, tokens, want):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    assert df.select(ngrams("t", 2)).first()[0] == want
    ml = NGram(n=2, inputCol="t", outputCol="g").transform(df).first().g
    assert ml == want


def test_trigrams_equal_ml(spark):
    df = spark.createDataFrame([(list("abcde"),), (["a", "b"],)], "t array<string>")
    ml = NGram(n=3, inputCol="t", outputCol="g").transform(df)
    rows = ml.select("g", ngrams("t", 3).alias("n")).collect()
    assert all(r.g == r.n for r in rows)


def test_filter_short_tokens(spark):
    df = spark.createDataFrame([(["ab", "abc", "", "abcd"],)], "t array<string>")
    assert df.select(filter_short_tokens("t")).first()[0] == ["abc", "abcd"]
