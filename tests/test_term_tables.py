"""Tables bucketed by term: values, salted frequent terms, no Exchange in the join, reopening."""

import math
from collections import Counter

import pytest

from revlens.plans.term_tables import open_terms, store_terms


@pytest.fixture()
def docs(spark):
    # one word in every text, one in a third of them
    rows = [(i, ["the"] + (["third"] if i % 3 == 0 else []) + [f"w{i % 40}"] * (1 + i % 3)) for i in range(600)]
    return spark.createDataFrame(rows + [(1000, [])], "doc_id long, words array<string>").repartition(4)


def _tfidf(rows, n):
    df = Counter(t for _, ws in rows for t in set(ws))
    return {(d, t): (c, round(c * math.log((n + 1) / (df[t] + 1)), 9)) for d, ws in rows for t, c in Counter(ws).items()}


def test_values_and_plan(spark, docs, tmp_path):
    tables = store_terms(docs, "words", str(tmp_path / "t"), buckets=5)
    want = _tfidf([(r.doc_id, r.words) for r in docs.collect()], 601)
    for each in (tables, open_terms(spark, str(tmp_path / "t"))):
        out = each.tfidf()
        assert {(r.doc_id, r.term): (r.tf, round(r.tfidf, 9)) for r in out.collect()} == want
        assert out.count() == len(want)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        each.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("term_")]


def test_frequent_terms_are_dealt(spark, docs, tmp_path):
    tables = store_terms(docs, "words", str(tmp_path / "t"), buckets=5)
    salts = {r.term: r.salts for r in tables._hot().collect()}
    rows = 600 + 200 + 600
    assert salts == {"the": math.ceil(600 * 5 / rows)}
    counts = spark.table(tables.tables["tf"])
    per = [r["count"] for r in counts.where("term = 'the'").groupBy("salt").count().collect()]
    assert sum(per) == 600 and len(per) == salts["the"] and max(per) < 2 * 600 / salts["the"]
    assert spark.table(tables.tables["df"]).where("term = 'the'").count() == salts["the"]
    tables.close()


def test_other_tables_and_min_doc_freq(spark, docs, tmp_path):
    """A table with several rows a term, terms without counts and counts without a row."""
    tables = store_terms(docs, "words", str(tmp_path / "t"), buckets=5)
    theta = spark.createDataFrame([("the", 0, 1.0), ("the", 1, 2.0), ("w3", 0, 5.0), ("nowhere", 0, 9.0)], "term string, label int, theta double")
    tables.add("theta", theta)
    got = Counter((r.term, r.label, r.theta) for r in tables.join("theta").collect())
    assert got == {("the", 0, 1.0): 600, ("the", 1, 2.0): 600, ("w3", 0, 5.0): 15}
    left = tables.join("theta", "left")
    assert left.where("theta IS NULL").count() == left.count() - 1215
    with pytest.raises(ValueError):
        tables.add("theta", theta)
    with pytest.raises(ValueError):
        tables.add("x", theta.withColumnRenamed("label", "salt"))
    assert {r.term for r in tables.tfidf(100).where("idf > 0").collect()} == {"the", "third"}
    tables.close()


def test_empty(spark, docs, tmp_path):
    tables = store_terms(docs.limit(0), "words", str(tmp_path / "t"), buckets=3)
    assert tables.tfidf().count() == 0 and tables.n_docs == 0
    tables.close()
    again = open_terms(spark, str(tmp_path / "t"))
    assert again.tfidf().columns == ["term", "doc_id", "tf", "df", "idf", "tfidf"] and again.tfidf().count() == 0
    again.close()


def test_query_leaves_no_tables(spark, tmp_path):
    from revlens.plans.catalog import SPARK_QUERIES
    sf = str(tmp_path / "sf")
    spark.createDataFrame([(1, "red red blue"), (2, "blue"), (3, None)], "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    before = {t.name for t in spark.catalog.listTables()}
    out = SPARK_QUERIES["tfidf_bucketed"](spark, sf)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert {(r.doc_id, r.term, r.tf) for r in out.collect()} == {(1, "red", 2), (1, "blue", 1), (2, "blue", 1)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
