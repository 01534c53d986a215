"""Approximate nearest neighbours: a forest of random-projection trees.

Trees are fitted on a bounded sample (``SAMPLE`` vectors, picked by a hash
order): each node splits its part of the sample at the median of the
projection on the difference of two of its points.  All vectors are then
routed to one leaf of every tree.  A query searches all trees through one
priority queue, best margin first, until the leaves it has opened hold
``search_k`` vectors; every vector in those leaves is ranked by its exact
distance in double precision.  Unless it is given, ``search_k`` is a share of
the indexed vectors: leaves grow with the table, so a fixed number of vectors
would open ever fewer of them and lose neighbours.  The work of all queries
therefore grows with the square of the table.

Equal vectors are one class and are indexed once, so a vector that a third of
all rows share doesn't fill a leaf; the k + 1 smallest ids of a class are
enough for any answer.

Vectors that are NULL, zero, or hold NULL or non-finite components take no
part, nor do those whose length isn't the most frequent one.  Rows that repeat
a vec_id count once per different vector; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.shuffle_tools import join_weighted, written

TREES = 24
SAMPLE = 20_000
#: Sample points of a leaf, about.
LEAF = 100
#: Vectors in the leaves that a query opens, repeats included: this share of the different vectors (recall 0.9 or
#: more on vectors without structure, see README) and at least ``SEARCH_LEAST``.
SEARCH_SHARE = 0.7
SEARCH_LEAST = 24_000
#: Queries compared with a part of a leaf at once.
QUERY_BLOCK = 256
#: Vectors of a leaf compared in one task call; larger leaves are dealt to several.
PART = 4096


class Forest:
    """Complete binary trees in arrays: nodes in heap order, leaves at one depth."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 6):
        rng = np.random.default_rng(seed)
        n, d = sample.shape
        self.depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
        inner = (1 << self.depth) - 1
        self.normal = np.zeros((trees, inner, d), np.float32)
        self.cut = np.zeros((trees, inner), np.float32)
        for t in range(trees):
            parts = {0: np.arange(n)}
            for node in range(inner):
                mine = parts.pop(node)
                pair = sample[rng.choice(mine, 2, replace=len(mine) < 2)] if len(mine) else np.zeros((2, d))
                normal = pair[0] - pair[1]
                size = np.linalg.norm(normal)
                normal = normal / size if size > 0 else rng.normal(size=d) / np.sqrt(d)
                side = sample[mine] @ normal
                self.normal[t, node] = normal
                self.cut[t, node] = np.median(side) if len(mine) else 0.0
                right = side > self.cut[t, node]
                parts[2 * node + 1], parts[2 * node + 2] = mine[~right], mine[right]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree (vectors x trees)."""
        out = np.zeros((len(x), len(self.cut)), np.int32)
        for t in range(len(self.cut)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                margin = np.einsum("ij,ij->i", x, self.normal[t][node]) - self.cut[t][node]
                node = 2 * node + 1 + (margin > 0)
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def probe(self, q: np.ndarray, held: dict[tuple[int, int], int], search_k: int) -> list[tuple[int, int]]:
        """Leaves in order of margin, over all trees in one queue, until they hold ``search_k`` vectors."""
        inner = (1 << self.depth) - 1
        queue = [(-np.inf, t, 0) for t in range(len(self.cut))]
        heapq.heapify(queue)
        out, got = [], 0
        while queue and got < search_k:
            worst, t, node = heapq.heappop(queue)
            if node >= inner:
                if n := held.get((t, node - inner), 0):
                    out.append((t, node - inner))
                    got += n
                continue
            margin = float(q @ self.normal[t, node] - self.cut[t, node])
            heapq.heappush(queue, (max(worst, -margin), t, 2 * node + 2))
            heapq.heappush(queue, (max(worst, margin), t, 2 * node + 1))
        return out


def _matrix(column, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, d)


def _near(x: np.ndarray, q: np.ndarray, k: int) -> list[np.ndarray]:
    """Places in ``x``, ascending, among which the k nearest of each query are, ties and rounding included."""
    every = np.arange(len(x))
    if len(x) <= k:
        return [every] * len(q)
    with np.errstate(over="ignore", invalid="ignore"):
        size, own = (x ** 2).sum(1), (q ** 2).sum(1)
        rough = size + own[:, None] - 2 * (q @ x.T)
        # far above the rounding error of the product form
        reach = np.partition(rough, k - 1, 1)[:, k - 1] + 1e-14 * x.shape[1] * (size.max() + own)
    safe = np.isfinite(rough).all(1) & (own < 1e300) & (size.max() < 1e300)
    return [np.flatnonzero(r <= to) if ok else every for r, to, ok in zip(rough, reach, safe)]


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``vec_id, v array<double>`` of the vectors that take part, and their length (0: none)."""
    v = F.col(vector_col).cast("array<double>")
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("v").isNotNull() & F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    sizes = src.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = sizes["d"] if sizes else 0
    return src.where(F.size("v") == d), d


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding",
            trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, search_k: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each query (rows whose id ``every`` divides)."""
    spark = vectors.sparkSession
    src, d = valid_vectors(vectors, id_col, vector_col)
    result = "query_id long, rank int, vec_id long, score double"
    if not d:
        return spark.createDataFrame([], result)
    src = written(src.distinct(), "forest-vectors")
    classes = written(src.groupBy("v").agg(F.min("vec_id").alias("class"), F.count("*").alias("copies")), "forest-classes")
    picked = classes.orderBy(F.xxhash64("class")).limit(sample).select("v").toArrow()["v"].combine_chunks()
    forest = spark.sparkContext.broadcast(Forest(_matrix(picked, d), trees, leaf))

    def route(batches):
        for batch in batches:
            x = _matrix(batch.column(1), d)
            at = forest.value.leaves(x)
            data = pa.array([r.tobytes() for r in x], pa.binary())
            for t in range(at.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(at[:, t]), batch.column(0), data],
                                                 names=["tree", "leaf", "class", "data"])
    index = written(classes.select("class", "v").mapInArrow(route, "tree int, leaf int, class long, data binary"), "forest-index")
    # one row per leaf of the forest, whose size is bounded by the sample
    held = {(r["tree"], r["leaf"]): r["count"] for r in index.groupBy("tree", "leaf").count().collect()}
    sizes = spark.sparkContext.broadcast(held)
    if search_k is None:  # every tree holds every class once
        search_k = max(SEARCH_LEAST, math.ceil(SEARCH_SHARE * sum(n for (t, _), n in held.items() if t == 0)))

    def probe(batches):
        for batch in batches:
            x = _matrix(batch.column(1), d)
            found = [forest.value.probe(q, sizes.value, search_k) for q in x]
            rows = np.repeat(np.arange(len(x)), [len(f) for f in found])
            flat = np.array([p for f in found for p in f], np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[:, 0]), pa.array(flat[:, 1]), batch.column(0).take(pa.array(rows)), pa.array([x[r].tobytes() for r in rows], pa.binary())],
                names=["tree", "leaf", "query_id", "data"])
    queries = src.where(F.col("vec_id") % every == 0)
    probes = queries.mapInArrow(probe, "tree int, leaf int, query_id long, data binary")
    parts = F.broadcast(spark.createDataFrame([(t, leaf_no, -(-n // PART)) for (t, leaf_no), n in held.items()], "tree int, leaf int, parts int"))
    rows = index.join(parts, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).drop("parts")
    probes = probes.join(parts, ["tree", "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k + 1 nearest vectors of a leaf for each query that opens it, by exact distance."""
        read = lambda t: np.frombuffer(b"".join(t["data"].to_pylist()), np.float64).reshape(-1, d)
        x, q, own = read(left), read(right), left["class"].to_numpy()
        order = np.argsort(own)
        x, own = x[order], own[order]
        out = []
        ids = right["query_id"].to_pylist()
        for at in range(0, len(q) if len(x) else 0, QUERY_BLOCK):
            for some, one, query in zip(_near(x, q[at:at + QUERY_BLOCK], k + 1), q[at:], ids[at:]):
                away = np.sqrt(((x[some] - one) ** 2).sum(1))
                best = np.argsort(away, kind="stable")[:k + 1]  # ties: the smaller class first
                out.append((np.full(len(best), query), own[some[best]], away[best]))
        cols = [np.concatenate(c) for c in zip(*out)] if out and len(x) else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": cols[0], "class": cols[1], "score": cols[2]})
    keys = ["tree", "leaf", "part"]
    scored = rows.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(compare, "query_id long, class long, score double") \
        .groupBy("query_id", "class").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "class")
    near = written(scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"), "forest-near")

    # the k + 1 smallest ids of each class that was found: first in parts of it, then of all of it
    shared = classes.where("copies > 1")
    members = join_weighted(src, shared, ["v"], "copies", "inner").select("class", "vec_id")
    in_part = Window.partitionBy("class", "part").orderBy("vec_id")
    in_class = Window.partitionBy("class").orderBy("vec_id")
    members = members.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for w in (in_part, in_class):
        members = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r")
    members = members.select("class", "vec_id").unionByName(classes.where("copies = 1").select("class", F.col("class").alias("vec_id")))
    ranked = near.join(members, "class").where("vec_id <> query_id") \
        .groupBy("query_id", "vec_id").agg(F.min("score").alias("score")) \
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
