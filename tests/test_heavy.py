"""Heavy-hitter vocabularies against the full count."""

import random

import pytest

from revlens.operators.heavy import heavy_vocabulary
from revlens.operators.termstats import vocabulary


@pytest.fixture(scope="module")
def skewed(spark):
    """A few frequent terms among many rare ones; a term holds a third of all tokens."""
    draw = random.Random(5)
    common = [f"c{i}" for i in range(40)]
    docs = [(i, ["hot"] * 10 + [draw.choice(common[:1 + j]) for j in range(20)] + [f"r{draw.randrange(10**7)}" for _ in range(5)])
            for i in range(600)]
    return spark.createDataFrame(docs + [(600, []), (601, None)], "doc_id long, words array<string>").repartition(7).cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size,tracked,proved", [(20, 2000, True), (20, 200_000, True), (30, 64, False), (2000, 200, False)])
def test_equals_the_full_count(skewed, size, tracked, proved):
    """Few counters can't prove the result and the full count takes over; it is the same in every case."""
    got = heavy_vocabulary(skewed, "words", size, tracked=tracked)
    assert rows(got.table) == rows(vocabulary(skewed, "words", size))
    assert got.proved == proved


def test_bound_holds(skewed):
    """Every term that is no candidate occurs at most as often as the bound says."""
    got = heavy_vocabulary(skewed, "words", 20, tracked=2000)
    named = {r.term for r in heavy_vocabulary(skewed, "words", 40, tracked=2000).table.collect()}
    others = [r.cf for r in vocabulary(skewed, "words", 100_000).collect() if r.term not in named]
    assert others and max(others) <= max(got.bound, 1)


def test_flat_and_empty(spark, skewed):
    flat = spark.createDataFrame([(["t%d" % i],) for i in range(500)], "words array<string>")
    got = heavy_vocabulary(flat, "words", 10)  # ties everywhere: the cut list proves nothing
    assert not got.proved and rows(got.table) == rows(vocabulary(flat, "words", 10))
    assert heavy_vocabulary(skewed.limit(0), "words", 10).table.count() == 0
    odd = spark.createDataFrame([([None, "a", "a"],), (None,), ([],)], "words array<string>")
    assert rows(heavy_vocabulary(odd, "words", 10).table) == [("a", 0, 2)]


def test_unprovable_needs_no_second_pass(spark, skewed, monkeypatch):
    """Where the estimates show that no count can pass the bound, candidates are not counted."""
    from revlens.operators import heavy
    written = []
    path = heavy.scratch_path
    monkeypatch.setattr(heavy, "scratch_path", lambda s, name: written.append(name) or path(s, name))
    got = heavy_vocabulary(skewed, "words", 30, tracked=64)
    assert not got.proved and written == ["heavy-candidates"]
    assert rows(got.table) == rows(vocabulary(skewed, "words", 30))


def test_all_terms_counted_proves_the_result(spark):
    """Terms that are all named leave nothing over, whatever the sketch's own bound."""
    df = spark.createDataFrame([(["a"] * 500 + ["b"] * 3 + ["c"],)] * 40, "words array<string>")
    got = heavy_vocabulary(df, "words", 2, tracked=64)
    assert got.proved and got.bound == 0 and rows(got.table) == [("a", 0, 20000), ("b", 1, 120)]


def test_query_prepares_its_words_once(spark, tmp_path, monkeypatch):
    from revlens.plans import catalog
    spark.createDataFrame([(i, f"some words here and {i} others") for i in range(9)], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    seen, heavy = [], catalog.heavy_vocabulary
    monkeypatch.setattr(catalog, "heavy_vocabulary", lambda df, *a: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or heavy(df, *a))
    assert catalog.q_vocab_heavy_hitters(spark, str(tmp_path)).count() > 0
    assert len(seen) == 2 and not any("regexp" in plan for plan in seen)
