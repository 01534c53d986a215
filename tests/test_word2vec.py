"""Word2Vec with its vocabulary and matrices in tables: tree, training in blocks, document vectors, saving, streaming."""

import heapq
import random

import numpy as np
import pytest

from revlens.operators.word2vec import first_vectors, fit_word2vec, huffman_tree, train_block


def _cost(counts):
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@pytest.mark.parametrize("seed", range(6))
def test_tree_is_a_huffman_tree(seed):
    rng = random.Random(seed)
    histogram = [(c, rng.randint(1, 9)) for c in rng.sample(range(1, 60), rng.randint(1, 12))]
    tree = huffman_tree(histogram)
    counts = [c for c, n in sorted(histogram) for _ in range(n)]
    nodes, bits = tree.paths(np.arange(len(counts)))
    depth = (nodes >= 0).sum(1)
    assert int((depth * counts).sum()) == _cost(counts)
    assert len(counts) == 1 or sum(2.0 ** -d for d in depth) == 1
    codes = {"".join(map(str, b[:d][::-1])) for b, d in zip(bits, depth)}  # from the root down
    assert len(codes) == len(counts)
    # two children a node: a node is named with both branches
    branches = {(int(n), int(b)) for row, bit, d in zip(nodes, bits, depth) for n, b in zip(row[:d], bit[:d])}
    assert len(branches) == 2 * (len(counts) - 1)


def test_a_batch_of_one_pair_is_the_gradient():
    tree = huffman_tree([(1, 2), (3, 1)])
    path, bits = tree.paths(np.arange(3))
    syn0, syn1 = first_vectors(np.arange(3), 4, 7), np.full((2, 4), 0.5, np.float32)
    want0, want1 = syn0.copy(), syn1.copy()
    for a, b in ((0, 1), (1, 0)):  # centre, neighbour: both at the matrices of the batch's beginning
        for n, bit in zip(path[a], bits[a]):
            if n >= 0:
                g = (1 - bit - 1 / (1 + np.exp(-syn0[b] @ syn1[n - 3]))) * 0.1
                want0[b] += g * syn1[n - 3]
                want1[n - 3] += g * syn0[b]
    used0, used1 = train_block(np.array([0, 1, 2]), np.array([0, 0, 1]), np.where(path >= 0, path - 3, -1), bits, syn0, syn1,
                               np.random.default_rng(1), lambda done: 0.1)
    assert np.allclose(syn0, want0, atol=1e-6) and np.allclose(syn1, want1, atol=1e-6)
    assert used0.tolist() == [True, True, False] and used1.all()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows = [(i, [f"{'ab'[i % 2]}{rng.randrange(20)}" for _ in range(30)]) for i in range(300)]
    rows += [(1000, []), (1001, None), (1001, ["a1"]), (1002, ["only here"]), (1002, ["only", "here"]), (None, ["a1", "b1"])]
    return spark.createDataFrame(rows, "id long, w array<string>").cache()


def test_words_of_a_topic_meet_in_several_blocks(corpus):
    model = fit_word2vec(corpus, "w", vector_size=20, min_count=0, iterations=5, partitions=1, block_words=4000)
    v = {r["word"]: np.array(r["vector"]) for r in model.table.collect()}
    assert len(v) == 43 and all(len(x) == 20 and np.isfinite(x).all() for x in v.values())

    def cos(xs, ys):
        return np.mean([v[x] @ v[y] / np.linalg.norm(v[x]) / np.linalg.norm(v[y]) for x in xs for y in ys if x != y])
    a, b = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)]
    assert cos(a, a) > 0.5 and cos(b, b) > 0.5 and cos(a, b) < 0
    extra = corpus.sparkSession.createDataFrame([(7, ["a1", "unknown"]), (8, ["unknown"])], "id long, w array<string>")
    out = model.transform(corpus.unionByName(extra), "w", "vec")
    assert out.columns == ["id", "w", "vec"]
    rows = out.collect()
    assert len(rows) == corpus.count() + 2
    for r in rows:
        words = r["w"] or []
        want = sum((v.get(x, np.zeros(20)) for x in words), np.zeros(20)) / max(len(words), 1)
        assert np.abs(r["vec"].toArray() - want).max() < 1e-9


def test_training_frees_its_files(corpus, spark):
    """Rows of blocks, sentences and shuffle files do not pile up over the iterations."""
    import glob

    from revlens.session import SHUFFLE_CLEANUP_CONF, checkpoint_root

    def shuffle_files():
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum(x.startswith("shuffle_") for x in disk.getAllFiles().mkString("\n").replace("/", "\n").split("\n"))
    root = checkpoint_root(spark).removeprefix("file:")
    tables = set(glob.glob(f"{root}/w2v-*"))
    n = shuffle_files()
    model = fit_word2vec(corpus, "w", vector_size=8, min_count=0, iterations=3, partitions=2)
    assert shuffle_files() <= n and spark.conf.get(SHUFFLE_CLEANUP_CONF, "false") == "false"
    rows = {p.rsplit("/", 1)[1].rsplit("-", 1)[0]: 0 for p in set(glob.glob(f"{root}/w2v-*")) - tables}
    for p in set(glob.glob(f"{root}/w2v-*")) - tables:
        rows[p.rsplit("/", 1)[1].rsplit("-", 1)[0]] += spark.read.parquet(p).count()
    assert {k for k, v in rows.items() if v} == {"w2v-counts", "w2v-vocabulary", "w2v-vectors"}
    assert model.table.count() == rows["w2v-vectors"] == 43


def test_rare_words_of_a_block_share_their_nodes(spark):
    """Words that occur once: a block needs the nodes above its own, few that other blocks need too."""
    from pyspark.sql import functions as F

    from revlens.operators.word2vec import numbered_vocabulary
    counts = spark.range(4096).select(F.concat(F.lit("w"), F.hash("id")).alias("term"), F.lit(1).alias("cf"),
                                      F.pmod(F.xxhash64("id"), F.lit(16)).cast("int").alias("first"))
    rows = numbered_vocabulary(counts).join(counts, "term").collect()
    assert sorted(r["id"] for r in rows) == list(range(4096))
    tree = huffman_tree([(1, 4096)])
    needed = 0
    for block in range(16):
        nodes, _ = tree.paths(np.array([r["id"] for r in rows if r["first"] == block]))
        needed += len(np.unique(nodes[nodes >= 0]))
    assert needed < 1.1 * 4096


def test_document_sums_are_dealt_once(spark):
    from revlens.plans.ml_catalog import _document_sums
    out = spark.createDataFrame([(1, ["a", "b", "a", "x"]), (1, ["c"]), (2, ["c", "d"]), (3, []), (4, None), (None, ["a"])],
                                "doc_id long, w2v_words array<string>")
    vectors = spark.createDataFrame([(w, [float(i), 1.0]) for i, w in enumerate("abcd")], "term string, wv array<float>")
    hot, cold = _document_sums(out, vectors, spark.createDataFrame([("a", 9), ("c", 9)], "term string, df long"), 2)
    assert {r["doc_id"]: r["s"] for r in hot.collect()} == {1: [2.0, 3.0], 2: [2.0, 1.0], None: [0.0, 1.0]}
    assert {r["doc_id"]: r["s"] for r in cold.collect()} == {1: [1.0, 1.0], 2: [3.0, 1.0]}
    for part in (hot, cold):  # no shuffle of partial sums
        plan = part._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
        dealt = [x for x in plan.splitlines() if "hashpartitioning(doc_id" in x]
        assert dealt and all("REPARTITION_BY_COL" in x for x in dealt)


def test_vocabulary_by_count(corpus, spark):
    model = fit_word2vec(corpus, "w", vector_size=4, min_count=2, iterations=1)
    assert model.table.count() == 40
    with pytest.raises(ValueError):
        fit_word2vec(corpus, "w", min_count=10 ** 6)


def test_pipeline_keeps_its_vocabulary_in_a_table(spark, tmp_path):
    from revlens.plans.persist import load_fitted, save_fitted
    from revlens.plans.pipelines import fit_extractor, score
    from revlens.streaming import score_files
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(f"{('good', 'bad')[i % 2]}word{rng.choice('xyzuvw')}" for _ in range(12)), float(i % 2))
                                  for i in range(80)] + [(900, None, 1.0)], "doc_id long, text string, label double")
    fitted = fit_extractor(docs.where("text IS NOT NULL"), "word2vec", ("lr",), w2v_params={"vectorSize": 8, "minCount": 0, "maxIter": 2})
    # no stage of the model, which the driver holds, has the vocabulary's size
    assert [type(s).__name__ for s in fitted.model.stages] == ["LogisticRegressionModel"]
    words = {w for r in fitted.transform(docs).select("w2v_words").collect() for w in r["w2v_words"]}
    assert {r["word"] for r in fitted.vectors.table.collect()} == words
    path = str(tmp_path / "model")
    save_fitted(spark, fitted, path, "word2vec")
    loaded, _ = load_fitted(spark, path)
    want = sorted((r["doc_id"], r["prediction"]) for r in score(docs, fitted, "lr").collect())
    assert sorted((r["doc_id"], r["prediction"]) for r in score(docs, loaded, "lr").collect()) == want
    assert sum(p == float(i % 2) for i, p in want if i < 900) == 80
    docs.write.parquet(str(tmp_path / "in"))
    sink = score_files(spark, str(tmp_path / "in"), docs.schema, loaded, "lr", ["doc_id"], str(tmp_path / "sink"), str(tmp_path / "ck"))
    assert sorted((r["doc_id"], r["prediction"]) for r in spark.read.parquet(sink).collect()) == want
