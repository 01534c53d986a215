"""Collocations, the digest index and periodic runs against plain-Python versions."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from revlens.llm import text_kernel  # noqa: E402
from revlens.llm.collocations import collocations  # noqa: E402
from revlens.llm.digest_index import deduplicate, digested, open_index  # noqa: E402
from revlens.llm.periodic_runs import periodic_runs, run_report, with_planted_period  # noqa: E402
from revlens.llm.queries import op13_periodic_runs  # noqa: E402
from revlens.session import scratch_path  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, lang string, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def with_odd_columns(df):
    return df.select("*", *[F.lit(1).alias(c) for c in ("shard", "words", "n", "a", "digest", "place", "kept", "runs", "_h", "_words", "batch")])


@pytest.fixture(scope="module")
def odd():
    """A few documents and the cases that need a defined result."""
    draw = random.Random(7)
    text = "\n".join(" ".join(draw.choice(["New", "york", "city", "a", "the", "b;c", "x"]) for _ in range(12)) for _ in range(8))
    return [(i, draw.choice(["en", "de", None]), f"{text[i * 7:]} in new york city, the {'a ' * (i % 30)}") for i in range(50)] + [
        (100, "en", None), (101, None, ""), (102, "", " \n\t "), (100, "en", None), (None, "und", "in new york city"),
        (None, "und", "in  new\tyork city"), (103, "ünd", "É é K     a"), (104, "en", "in new york city. " * 3000),
        (105, "en", "a b " * 2000), (106, "en", "y" * 5000), (104, "en", "in new york city. " * 3000), (107, "en", "in new york city."),
        (50, "de", "in new\n\nyork city"), (3, "de", "in new york city")]


@pytest.fixture(scope="module")
def odd_df(spark, odd):
    return with_odd_columns(spark.createDataFrame(odd, DOCS)).repartition(5).cache()


@pytest.mark.parametrize("threshold,shards,bits", [(4, 3, 1 << 24), (3, 2, 1 << 6)])
def test_collocations(spark, odd, odd_df, threshold, shards, bits):
    """Bitmaps so small that every bit is set change nothing."""
    want = brute.collocations([x[1:] for x in odd], threshold=threshold, top=40)
    assert want and rows(collocations(odd_df, 40, shards, threshold, filter_bits=bits)) == want


def test_collocations_of_nothing(spark, odd_df):
    assert collocations(odd_df.limit(0), threshold=2).count() == 0
    assert collocations(odd_df.where("text IS NULL OR text = ''"), threshold=2).count() == 0


def test_digest_dedup(spark, odd, odd_df):
    docs = [(d, t) for d, _, t in odd]
    got = deduplicate(odd_df, scratch_path(spark, "digest-index")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("s"))
    assert rows(got) == brute.exact_groups(docs)
    assert deduplicate(odd_df.limit(0), scratch_path(spark, "digest-index")).count() == 0


def test_digest_index_persists(spark, odd_df):
    """A second session table finds the rows of the first; known texts are not added again; the index is not shuffled."""
    path = scratch_path(spark, "digest-index")
    first, second = digested(odd_df.where("doc_id < 60")), digested(odd_df)
    index = open_index(spark, path, 8)
    index.add(first)
    n = index.rows().count()
    index.add(first)
    assert index.rows().count() == n == first.select("digest").distinct().count()
    index.close()
    again = open_index(spark, path, 8)
    assert again.rows().count() == n
    again.add(second)
    assert again.rows().count() == second.select("digest").distinct().count() and again.generations() == 2
    known = first.select("digest")
    late = again.report(second).join(known, "digest", "left_semi").agg(F.max(F.col("kept").cast("int"))).first()[0]
    assert late == 0
    plan = second.select("digest").distinct().join(again.rows().select("digest").hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") <= 2  # the batch's own
    scan = text[text.index("FileScan parquet spark_catalog"):]
    assert "Bucketed: true" in scan
    again.close()


def test_runs(spark, odd, odd_df):
    assert rows(run_report(with_planted_period(odd_df))) == brute.run_report([(d, t) for d, _, t in odd])
    assert run_report(with_planted_period(odd_df.limit(0))).count() == 0


def test_runs_of_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"]) < 20_000]
    got = {r[0]: r for r in rows(op13_periodic_runs(spark, SF))}
    assert [got[r[0]] for r in brute.run_report(docs)] == brute.run_report(docs)
    assert any(r[1] for r in got.values())


def test_runs_of_random_words(spark):
    """Short alphabets, nested periods and stretches that nearly repeat."""
    draw = random.Random(3)
    docs = []
    for i in range(400):
        unit = [draw.choice("ab") for _ in range(draw.randint(1, 9))]
        w = [draw.choice("abc") for _ in range(draw.randint(0, 20))] + unit * draw.randint(1, 9) + unit[:draw.randint(0, len(unit))]
        w += (["a"] * draw.randint(0, 12) + ["b"]) * draw.randint(0, 6)
        for _ in range(draw.randint(0, 2)):
            w[draw.randrange(len(w))] = draw.choice("abcA")
        docs.append((-i, " ".join(w)))
    got = periodic_runs(spark.createDataFrame(docs, "doc_id long, text string"))
    want = {d: brute.runs(t.split()) for d, t in docs}
    assert {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in got.collect()} == want
    assert sum(map(len, want.values())) > 300


def test_long_texts_are_split_in_parts():
    """Parts change neither words nor hashes, whatever stands at their ends."""
    draw = np.random.default_rng(5)
    for table in (text_kernel.ALNUM, text_kernel.NON_SPACE):
        data = draw.choice(np.frombuffer("aB 7-\né".encode(), np.uint8), 4000)
        data[1000:1400] = 97
        offsets = np.array([0, 0, 10, 1200, 3990, 4000])
        whole, parts = (text_kernel.words_of(data, offsets, table, part=p) for p in (1 << 20, 64))
        for name in ("buf", "start", "end", "hash", "first"):
            assert np.array_equal(getattr(whole, name), getattr(parts, name))


def test_one_long_text_of_one_word(spark):
    """A million equal words: linear work, one run."""
    df = spark.createDataFrame([(1, "ab " * 1_000_000), (2, "a b c " * 300_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(df).collect()}
    assert got == {1: (1_000_000, [(0, 1_000_000, 1)], "ab"), 2: (900_000, [(0, 900_000, 3)], "a b c")}


def test_kept_rows_with_clashing_columns(spark):
    """A stage's decision takes effect whatever the documents' extra columns are called."""
    import corpus_pipeline
    docs = spark.createDataFrame([(1, "a", 7), (2, "b", 8), (None, "c", 9), (1, "d", 0)], "doc_id long, text string, kept_key long")
    kept = corpus_pipeline._keyed(docs, "doc_id", "text").where("text IN ('a', 'c')")
    assert rows(corpus_pipeline._keep(docs, kept, "doc_id", "text")) == [(1, "a", 7), (None, "c", 9)]


def test_long_texts_in_language_scores(monkeypatch):
    """A long text scored in parts gets the sums of the whole."""
    import pyarrow as pa

    from revlens.llm import language_id
    model = language_id.TextModel({"a": ["hello world this is text"], "b": ["bonjour le monde é"]})
    draw = random.Random(2)
    column = pa.array(["x", "".join(draw.choice("abcdé. Z") for _ in range(9000)), None, "yy"])
    want = model.score(column)
    monkeypatch.setattr(language_id, "PART_BYTES", 500)
    monkeypatch.setattr(language_id, "row_slices", lambda offsets: ((i, i + 1) for i in range(len(offsets) - 1)))
    for got, whole in zip(model.score(column), want):
        assert np.allclose(got, whole)
