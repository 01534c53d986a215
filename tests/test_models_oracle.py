"""Model, streaming and command-line queries against their oracles (sf0.001)."""

import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

from revlens.plans.ml_catalog import ML_QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels", "events", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ML_QUERIES))
def test_model_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    got = sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted(tuple(r[i] for i in order) for r in res.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want


def test_every_query_has_oracle_or_is_declared_rows_only():
    from revlens.plans.catalog import SPARK_QUERIES
    assert not ({*SPARK_QUERIES, *ML_QUERIES} - set(E.oracle_sql()))


def test_word2vec_rejects_naive_bayes(spark):
    from revlens.plans.pipelines import fit_extractor
    df = spark.createDataFrame([(1, "a b", 1.0)], "doc_id long, text string, label double")
    with pytest.raises(ValueError):
        fit_extractor(df, "word2vec", ("nb",))
