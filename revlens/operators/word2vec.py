"""Word2Vec (skip-gram, hierarchical softmax) whose vocabulary and matrices are tables.

MLlib's Word2Vec holds the vocabulary and both matrices on the driver and sends
them whole to every task.  This is the same training - the same objective,
windows, learning rate and averaging of the partitions' rows after every
iteration - with nothing of the vocabulary's size on the driver:

1. words are counted by Spark.  The driver sees how many words have each count (at
   most the square root of twice the corpus) and builds the Huffman tree over those
   runs of equal words; a word's path follows from its number;
2. sentences are dealt into blocks of about ``BLOCK_WORDS`` words, and words are
   numbered by count, equal ones by their first block.  A block needs the rows of
   its own words and of the inner nodes on their paths;
3. every iteration brings a block's rows to its sentences, trains there, and
   averages the rows of all blocks that trained them, by buckets of row ids.

What a task holds is a block's words and rows, whatever the size of the corpus.
Between iterations a row is kept once, not once a block; tables and shuffle files
go as soon as the next ones are written.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators.termstats import corpus_frequency
from revlens.session import empty_table, scratch_path, shuffles_released

#: Words of a block, and rows of a bucket in which blocks' rows are averaged.
BLOCK_WORDS, BUCKET_ROWS = 1_000_000, 200_000
#: MLlib's settings: words to either side, words of a sentence, bound on a node's score.
WINDOW, SENTENCE_WORDS, MAX_EXP = 5, 1000, 6.0
#: Positions trained at a time, and pairs of such a batch that count in full for one row: their
#: gradients are taken at the same rows, and a longer common step would overshoot.
BATCH, MAX_PAIRS = 64, 16
#: Words whose vectors are summed at a time.
SUM_WORDS = 50_000


# --- Huffman tree over runs of equal counts -------------------------------------------------

@dataclass
class Tree:
    """Nodes are numbered: words by ascending count, then inner nodes as they were made.

    ``start[s]`` is the first node of stretch s, ``parent[s]`` its parent, and
    ``second[s]`` 1 where the stretch is a single second child.
    """

    words: int
    start: np.ndarray
    parent: np.ndarray
    second: np.ndarray

    def paths(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner nodes on the way from each word up to the root (-1: none left), and the branch taken at each."""
        at, nodes, bits = np.asarray(words, np.int64), [], []
        root = 2 * self.words - 2
        alive = at != root
        while alive.any():
            s = np.searchsorted(self.start, at, "right") - 1
            step = at - self.start[s] + self.second[s]
            nodes.append(np.where(alive, self.parent[s] + step // 2, -1))
            bits.append(np.where(alive, step % 2, 0))
            at = np.where(alive, nodes[-1], at)
            alive = alive & (at != root)
        if not nodes:
            return np.full((len(at), 0), -1, np.int64), np.zeros((len(at), 0), np.int8)
        return np.stack(nodes, 1), np.stack(bits, 1).astype(np.int8)


def huffman_tree(histogram: list[tuple[int, int]]) -> Tree:
    """Tree over ``(count, words with that count)``; its size is that of the histogram, not of the vocabulary."""
    heap, n = [], 0
    for count, words in sorted(histogram):
        heap.append((count, n, n + words))  # equal words are a run of nodes
        n += words
    made, stretches = n, []
    heapq.heapify(heap)
    while heap:
        weight, lo, hi = heapq.heappop(heap)
        pairs = (hi - lo) // 2
        if pairs:
            stretches.append((lo, made, 0))
            heapq.heappush(heap, (2 * weight, made, made + pairs))
            made += pairs
            if (hi - lo) % 2:
                heapq.heappush(heap, (weight, hi - 1, hi))
        elif heap:  # a single node and the next one
            other, lo2, hi2 = heapq.heappop(heap)
            stretches += [(lo, made, 0), (lo2, made, 1)]
            if hi2 - lo2 > 1:
                heapq.heappush(heap, (other, lo2 + 1, hi2))
            heapq.heappush(heap, (weight + other, made, made + 1))
            made += 1
    stretches.sort()
    start, parent, second = (np.array([s[i] for s in stretches], np.int64) for i in range(3))
    return Tree(n, start, parent, second)


# --- a block -----------------------------------------------------------------------------------

def first_vectors(ids: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A word's first vector, uniform within half of 1 / size: by its number and the seed alone."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(size) + np.arange(size, dtype=np.uint64)[None, :]
    x = (x + np.uint64(seed * 0x9E3779B97F4A7C15 % 2 ** 64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (((x >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)) - np.float32(0.5)) / np.float32(size)


def _add_rows(matrix: np.ndarray, rows: np.ndarray, steps: np.ndarray, pairs: np.ndarray) -> None:
    """``matrix[rows] += steps``; rows repeat, and a row's step counts at most ``MAX_PAIRS`` of its pairs in full."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    total = np.add.reduceat(steps[order], first, axis=0)
    n = np.add.reduceat(pairs[order], first)
    matrix[rows[first]] += total * np.minimum(1.0, MAX_PAIRS / np.maximum(n, 1)).astype(np.float32)[:, None]


def train_block(tokens: np.ndarray, sentence: np.ndarray, nodes: np.ndarray, bits: np.ndarray, syn0: np.ndarray,
                syn1: np.ndarray, rng, alpha, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """One pass over ``tokens`` (rows of ``syn0``) of sentences numbered in ``sentence``; changes both matrices.

    ``nodes`` and ``bits`` are the path of every word (rows of ``syn1``, -1: none
    left), ``alpha`` the learning rate after so many words.  Returns which rows
    of the matrices took part.
    """
    used0, used1 = np.zeros(len(syn0), bool), np.zeros(len(syn1), bool)
    n, offsets = len(tokens), np.arange(-window, window + 1)
    depth = (nodes >= 0).sum(1)
    slot = np.zeros(len(syn1), np.int64)
    for a in range(0, n, BATCH):
        b = min(n, a + BATCH)
        # the neighbours of all positions, which overlap: near[p + k] is position p's neighbour k
        near = np.clip(np.arange(a - window, b + window), 0, n - 1)
        around = np.arange(a, b)[:, None] + offsets
        reach = window - rng.integers(0, window, b - a)
        mask = (np.abs(offsets) <= reach[:, None]) & (offsets != 0) & (around >= 0) & (around < n)
        mask &= sentence[near[np.arange(b - a)[:, None] + offsets + window]] == sentence[a:b, None]
        centres = tokens[a:b]
        length = int(depth[centres].max())
        if not length or not mask.any():
            continue
        pair = np.zeros((b - a, len(near)), np.float32)
        np.lib.stride_tricks.as_strided(pair, mask.shape, (pair.strides[0] + pair.strides[1], pair.strides[1]))[:] = mask
        path = nodes[centres, :length]
        row, step = np.nonzero((path >= 0) & mask.any(1)[:, None])
        ids = path[row, step]
        slot[ids] = np.arange(len(ids))  # the path's different nodes, and each one's place among them
        ids_once = ids[slot[ids] == np.arange(len(ids))]
        k = len(ids_once)
        slot[ids_once] = np.arange(k)
        # of the pairs of a neighbour and a node: how many there are, and how many go the first branch
        ways = np.zeros((b - a, 2 * k), np.float32)
        ways[row, slot[ids]] = 1.0
        ways[row, k + slot[ids]] = 1 - bits[centres[row], step]
        ways = pair.T @ ways
        words, node_rows = tokens[near], syn1[ids_once]
        x = syn0[words]
        f = x @ node_rows.T
        g = ways[:, k:] - ways[:, :k] / (1.0 + np.exp(-np.clip(f, -MAX_EXP, MAX_EXP)))
        g *= np.float32(alpha(a))
        g[np.abs(f) >= MAX_EXP] = 0.0
        seen = ways[:, :k].sum(0)
        syn1[ids_once] += (g.T @ x) * np.minimum(1.0, MAX_PAIRS / seen).astype(np.float32)[:, None]
        used1[ids_once] = True
        seen = pair.sum(0)
        hit = seen > 0
        _add_rows(syn0, words[hit], (g @ node_rows)[hit], seen[hit])
        used0[words[hit]] = True
    return used0, used1


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """The rows of a binary column without NULLs, not copied."""
    wide = pa.types.is_large_binary(column.type)
    start = np.frombuffer(column.buffers()[1], "<i8" if wide else "<i4", 1, column.offset * (8 if wide else 4))[0] if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", "<f4", len(column) * size, start).reshape(-1, size)


def _vectors(column: pa.Array, ids: np.ndarray, order: np.ndarray, words: int, size: int, seed: int) -> np.ndarray:
    """Rows of a binary column in ``order``; where there is none yet, a word's first vector or an inner node's zeros."""
    if not column.null_count:
        return _matrix(column, size)[order]
    out = np.zeros((len(ids), size), np.float32)
    none = column.is_null().to_numpy(zero_copy_only=False)
    out[~none] = _matrix(column.drop_null(), size)
    new = np.flatnonzero(none & (ids < words))
    out[new] = first_vectors(ids[new], size, seed)
    return out[order]


def _binary(rows: np.ndarray) -> pa.Array:
    """A matrix as binary values, one a row, not copied."""
    offsets = np.arange(0, 4 * rows.size + 1, 4 * rows.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows, "<f4"))])


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _flat(column) -> tuple[pa.Array, np.ndarray]:
    """The items of a list column and each row's number of them."""
    column = _one(column)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), lengths


_BLOCK = "block int, id long, data binary"
_TRAINED = "block int, id long, used boolean, vector binary"
_MEAN = "id long, vector binary"
_SENTENCES = "block int, words array<string>"
#: Rows of a block's table that are no ids: its tokens, its sentences' lengths.
_TOKENS, _LENGTHS = -1, -2


def _token_type(tree: Tree) -> str:
    return "<i4" if tree.words < 2 ** 31 else "<i8"


def _encoder(tree: Tree, sentence_words: int):
    def encode(key, sentences: pa.Table, words: pa.Table) -> pa.Table:
        """A block's sentences as word numbers, and the ids it needs: its words and the inner nodes above them."""
        ids = words.column("id").to_numpy().astype(np.int64)
        terms, lengths = _flat(sentences.column("words"))
        at = pc.index_in(terms, _one(words.column("term")))
        known = at.is_valid().to_numpy(zero_copy_only=False)
        tokens = ids[at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)]
        row = np.repeat(np.arange(len(lengths)), lengths)[known]
        kept = np.bincount(row, minlength=len(lengths))
        place = np.arange(len(row)) - np.repeat(np.cumsum(kept) - kept, kept)
        new = np.flatnonzero((place % sentence_words) == 0)
        cut = np.diff(np.append(new, len(row))).astype(np.int64)
        above = np.unique(tree.paths(ids)[0])
        need = np.concatenate([ids, above[above >= 0]])
        data = [tokens.astype(_token_type(tree)).tobytes(), cut.astype("<i8").tobytes()] + [None] * len(need)
        return pa.table({"block": pa.array(np.full(len(need) + 2, key[0].as_py()), pa.int32()),
                         "id": pa.array(np.concatenate([[_TOKENS, _LENGTHS], need]), pa.int64()), "data": pa.array(data, pa.binary())})
    return encode


def _trainer(tree: Tree, size: int, seed: int, iteration: int, iterations: int, blocks: int, total: int, step: float,
             window: int):
    def train(key, corpus: pa.Table, rows: pa.Table) -> pa.Table:
        """One iteration over a block: its rows as they are after it."""
        parts = dict(zip(corpus.column("id").to_pylist(), corpus.column("data").to_pylist()))
        tokens, lengths = np.frombuffer(parts[_TOKENS], _token_type(tree)), np.frombuffer(parts[_LENGTHS], "<i8")
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids)
        matrix = _vectors(_one(rows.column("vector")), ids, order, tree.words, size, seed)
        ids = ids[order]
        n = int(np.searchsorted(ids, tree.words))
        path, bits = tree.paths(ids[:n])
        local = np.where(path >= 0, np.searchsorted(ids[n:], path), -1)

        def alpha(done):
            return max(step * (1 - (blocks * done + iteration * total) / (iterations * total + 1)), step * 1e-4)
        rng = np.random.default_rng([seed, iteration, key[0].as_py()])
        used = train_block(np.searchsorted(ids[:n], tokens), np.repeat(np.arange(len(lengths)), lengths), local, bits,
                           matrix[:n], matrix[n:], rng, alpha, window)
        return pa.table({"block": pa.array(np.full(len(ids), key[0].as_py()), pa.int32()), "id": pa.array(ids, pa.int64()),
                         "used": pa.array(np.concatenate(used)), "vector": _binary(matrix)})
    return train


def _averager(size: int):
    def average(table: pa.Table) -> pa.Table:
        """Each id once, with the mean of its row over the blocks that trained it."""
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        matrix = _matrix(_one(table.column("vector")), size)[order]
        weight = table.column("used").to_numpy().astype(np.float32)[order]
        first = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1]))
        n = np.add.reduceat(weight, first)
        untrained = matrix[first[n == 0]]
        matrix *= weight[:, None]
        mean = np.add.reduceat(matrix, first, axis=0) / np.maximum(n, 1)[:, None]
        mean[n == 0] = untrained
        return pa.table({"id": pa.array(ids[order][first], pa.int64()), "vector": _binary(mean)})
    return average


def _floats(size: int):
    def run(batches):
        """Binary rows as lists of floats."""
        for batch in batches:
            rows = _matrix(batch.column(1), size)
            offsets = np.arange(0, rows.size + 1, size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))],
                                             names=["id", "vector"])
    return run


# --- Spark jobs ------------------------------------------------------------------------------

@dataclass
class WordVectors:
    """A trained model: ``table`` (word, vector array<float>), one row for every word of the vocabulary."""

    table: DataFrame
    size: int

    def transform(self, df: DataFrame, words_col: str, out_col: str) -> DataFrame:
        """``df`` plus the mean of the words' vectors as ``out_col``: over all words, unknown ones counting as zero.

        Each distinct list of words is summed once, in as many blocks as a shuffle has partitions; a block gets
        the vectors of its own words.
        """
        spark, key = df.sparkSession, "_w2v_key"
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        words = F.col(words_col)
        keyed = df.withColumn(key, F.when(F.size(words) > 0, F.sha2(F.to_json(words), 256)))
        lists = keyed.where(F.col(key).isNotNull()).select(key, words.alias("words")).dropDuplicates([key]) \
            .withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
        needed = lists.select("block", F.explode(F.array_distinct("words")).alias("word")).distinct()
        rows = needed.join(self.table.hint("merge"), "word").withColumnRenamed("block", "of")
        size = self.size

        def mean(key_, lists_: pa.Table, rows_: pa.Table) -> pa.Table:
            matrix = np.vstack([_flat(rows_.column("vector"))[0].to_numpy(zero_copy_only=False).reshape(-1, size),
                                np.zeros((1, size), np.float32)]).astype(np.float64)
            terms, lengths = _flat(lists_.column("words"))
            at = pc.index_in(terms, _one(rows_.column("word"))).fill_null(len(matrix) - 1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            sums, lo = np.zeros((len(lengths), size)), 0
            for a in range(0, len(at), SUM_WORDS):  # a list may reach over several slices
                b = min(len(at), a + SUM_WORDS)
                lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left"))
                begin = np.maximum(ends[lo:hi + 1] - lengths[lo:hi + 1] - a, 0)
                sums[lo:hi + 1] += np.add.reduceat(matrix[at[a:b]], begin, axis=0)
            sums /= np.maximum(lengths, 1)[:, None]
            offsets = np.arange(0, sums.size + 1, size, dtype=np.int32)
            return pa.table({key: lists_.column(key), "vector": pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()))})
        found = lists.groupBy("block").cogroup(rows.groupBy("of")).applyInArrow(mean, f"{key} string, vector array<double>") \
            .select(key, F.col("vector").alias("_w2v_vector"))
        zeros = F.array_repeat(F.lit(0.0), self.size)
        return keyed.join(found, key, "left") \
            .withColumn(out_col, array_to_vector(F.coalesce("_w2v_vector", zeros))).drop(key, "_w2v_vector")


def numbered_vocabulary(counts: DataFrame) -> DataFrame:
    """``term, id`` of ``term, cf, first``, in ascending order of ``(cf, first, term)`` from 0."""
    spark = counts.sparkSession
    path = scratch_path(spark, "w2v-vocabulary")
    counts.orderBy("cf", "first", "term").select("term", F.monotonically_increasing_id().alias("at")).write.parquet(path)
    stored = spark.read.schema("term string, at long").parquet(path)
    part = F.shiftrightunsigned("at", 33)
    sizes = [(r["part"], r["n"]) for r in stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()]
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = spark.createDataFrame(starts, "part long, before long")
    row = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.withColumn("part", part).join(F.broadcast(offsets), "part").select("term", (row + F.col("before")).alias("id"))


def fit_word2vec(df: DataFrame, words_col: str, vector_size: int = 100, min_count: int = 5, iterations: int = 1,
                 partitions: int = 1, seed: int = 42, step: float = 0.025, window: int = WINDOW,
                 sentence_words: int = SENTENCE_WORDS, block_words: int = BLOCK_WORDS) -> WordVectors:
    """Train on the lists of ``words_col``; ``partitions`` blocks at least, more where they would pass ``block_words``."""
    with shuffles_released(df.sparkSession):
        return _fit(df, words_col, vector_size, min_count, iterations, partitions, seed, step, window, sentence_words, block_words)


def _fit(df: DataFrame, words_col: str, vector_size: int, min_count: int, iterations: int, partitions: int, seed: int, step: float,
         window: int, sentence_words: int, block_words: int) -> WordVectors:
    spark = df.sparkSession
    path = scratch_path(spark, "w2v-counts")
    corpus_frequency(df, words_col).where(F.col("term").isNotNull() & (F.col("cf") >= min_count)).write.parquet(path)
    counts = spark.read.schema("term string, cf long").parquet(path)
    histogram = [(r["cf"], r["n"]) for r in counts.groupBy("cf").agg(F.count("*").alias("n")).collect()]
    if not histogram:
        raise ValueError("The vocabulary size should be > 0. You may need to check the setting of minCount.")
    tree = huffman_tree(histogram)
    total = sum(count * n for count, n in histogram)
    blocks = max(partitions, math.ceil(total / block_words))
    path = scratch_path(spark, "w2v-sentences")
    df.where(F.size(words_col) > 0).select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"),
                                           F.col(words_col).alias("words")).write.parquet(path)
    sentences = spark.read.schema(_SENTENCES).parquet(path)
    pairs = sentences.select("block", F.explode(F.array_distinct("words")).alias("term"))
    # of equal words, those of a block are neighbours in the tree: most nodes above rare words are needed by one block
    vocabulary = numbered_vocabulary(counts.join(pairs.groupBy("term").agg(F.min("block").alias("first")).hint("merge"), "term"))
    words = pairs.distinct().join(vocabulary.hint("merge"), "term").select("block", "term", "id")
    blocks_path = scratch_path(spark, "w2v-blocks")
    _by_block(sentences, blocks).cogroup(_by_block(words, blocks, "of")).applyInArrow(_encoder(tree, sentence_words), _BLOCK) \
        .write.parquet(blocks_path)
    empty_table(spark, path, _SENTENCES)
    corpus = spark.read.schema(_BLOCK).parquet(blocks_path).where("id < 0")
    need = spark.read.schema(_BLOCK).parquet(blocks_path).where("id >= 0").select("block", "id")
    buckets = max(spark.sparkContext.defaultParallelism, math.ceil(need.count() / BUCKET_ROWS))
    rows, before = need.withColumn("vector", F.lit(None).cast("binary")), None
    for k in range(iterations):
        train = _trainer(tree, vector_size, seed, k, iterations, blocks, total, step, window)
        path = scratch_path(spark, "w2v-rows")
        _by_block(corpus, blocks).cogroup(_by_block(rows, blocks, "of")).applyInArrow(train, _TRAINED).write.parquet(path)
        if before:
            empty_table(spark, before, _MEAN)
        before = scratch_path(spark, "w2v-mean")
        spark.read.schema(_TRAINED).parquet(path).select("id", "used", "vector") \
            .groupBy(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket")).applyInArrow(_averager(vector_size), _MEAN).write.parquet(before)
        empty_table(spark, path, _TRAINED)
        mean = spark.read.schema(_MEAN).parquet(before)
        rows = need.join(mean.hint("merge"), "id").select("block", "id", "vector")
    empty_table(spark, blocks_path, _BLOCK)
    path = scratch_path(spark, "w2v-vectors")
    mean.where(F.col("id") < tree.words).mapInArrow(_floats(vector_size), "id long, vector array<float>") \
        .join(vocabulary.hint("merge"), "id").select(F.col("term").alias("word"), "vector").write.parquet(path)
    empty_table(spark, before, _MEAN)
    return WordVectors(spark.read.schema("word string, vector array<float>").parquet(path), vector_size)


def _by_block(df: DataFrame, blocks: int, name: str = "block"):
    """A task for each block, however small its rows are: training takes longer than their bytes suggest."""
    named = df.withColumnRenamed("block", name)
    return named.repartitionById(blocks, F.col(name)).groupBy(name)
