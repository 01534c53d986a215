"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard.

Two permutations make every signature coordinate: ``sigma`` shuffles the
shingle universe once, and coordinate k is the smallest value of ``pi``
circularly shifted by k places, ``min over s of pi(sigma(s) - k mod D)`` with
D = 2**32.  Both are fixed bijective mixers.

Steps, each a Spark job over written tables:

1. one pass over the texts: shingle set size, set fingerprint, band keys;
2. texts with equal shingle sets collapse to one class (fingerprint);
3. in each band bucket the members are compared with the bucket's smallest
   member, exactly, on full sets; linked classes form components;
4. buckets that still hold several components: sets that share too few of
   their shingles with members of other components are finished; the rest is
   compared with the bucket's most central member, and what is then still open
   goes through an exact prefix-filtered join on shingles ordered by rarity.

Pairs already in one component need no further test, so a group of thousands
of near copies costs one comparison per member and bucket, not all pairs.

With 32 bands of 4 rows a pair at similarity 0.8 escapes every band with
probability (1 - 0.8**4)**32 = 5e-8; no cap is put on buckets or partners.

Defined results: NULL or wordless texts have an empty set, are linked with
nothing and are their own component.  Rows that repeat a doc_id keep one
result row each.  Equality of shingles and of whole sets is equality of
64-bit hashes.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.shuffle_tools import connected_components, join_weighted, written
from revlens.llm.text_kernel import NON_SPACE, as_long, mix64, row_slices, shingle_hashes, text_bytes, words_of

BANDS, ROWS = 32, 4
SHINGLE_WORDS = 4
#: Comparisons with a bucket's most central member before the remaining pairs are listed.
CENTER_ROUNDS = 1
#: Elements hashed at a time, so that the work arrays stay in the CPU cache.
_BLOCK = 1 << 15


def _sigma(x: np.ndarray) -> np.ndarray:
    return (mix64(x ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def _pi(x: np.ndarray) -> np.ndarray:
    """Bijection of 32-bit integers (multiply and xor-shift), in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def circulant_minhash(sets: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """Signatures (rows x coordinates) of non-empty sets stored back to back."""
    out = np.full((len(first), coordinates), 0xFFFFFFFF, np.uint32)
    universe = _sigma(sets)
    bound = np.append(first, len(sets))
    row = 0
    while row < len(first):  # whole sets of together about _BLOCK elements
        last = max(row + 1, int(np.searchsorted(bound, bound[row] + _BLOCK, "right")) - 1)
        part = universe[bound[row]:bound[last]]
        cuts = bound[row:last] - bound[row]
        for k in range(coordinates):
            out[row:last, k] = np.minimum.reduceat(_pi(part - np.uint32(k)), cuts)
        row = last
    return out


def shingle_sets(column, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (row_lo, row_hi, distinct shingle hashes by row, rows + 1 bounds)."""
    buf, offsets = text_bytes(column)
    for lo, hi in row_slices(offsets):
        w = words_of(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1], NON_SPACE)
        h, at = shingle_hashes(w, k)
        row = np.searchsorted(w.first, at, "right") - 1
        counts = w.counts
        short = np.flatnonzero((counts > 0) & (counts < k))
        for r in short:  # fewer words than a shingle: the whole sequence is one
            part = w.hash[w.first[r]:w.first[r + 1]]
            one = mix64(np.array([np.bitwise_xor.reduce(mix64(part + np.arange(1, len(part) + 1).astype(np.uint64)))
                                  + np.uint64(len(part))], np.uint64))
            h, row = np.append(h, one), np.append(row, r)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[fresh], row[fresh]
        yield lo, hi, h, np.searchsorted(row, np.arange(hi - lo + 1))


def _set_id(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint per non-empty set."""
    return mix64(np.add.reduceat(mix64(h + np.uint64(0x632BE59BD9B4E019)), bounds[:-1]) + np.diff(bounds).astype(np.uint64))


def _signatures(k: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi, h, bounds in shingle_sets(texts, k):
                sizes = np.diff(bounds)
                full = sizes > 0
                node = np.zeros(hi - lo, np.int64)
                keys = np.zeros((hi - lo, bands), np.int64)
                if full.any():
                    b = np.append(bounds[:-1][full], len(h))
                    node[full] = as_long(_set_id(h, b))
                    sig = circulant_minhash(h, b[:-1], bands * rows).astype(np.uint64).reshape(-1, bands, rows)
                    key = np.arange(bands, dtype=np.uint64)[None, :]
                    for r in range(rows):
                        key = mix64(key ^ (sig[:, :, r] << np.uint64(8)))
                    keys[full] = as_long(np.ascontiguousarray(key))
                empty = pa.array(~full)
                none = pa.scalar(None, pa.int64())
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (hi - lo + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(sizes.astype(np.int64)),
                     pa.compute.if_else(empty, none, pa.array(node)), lists],
                    names=["doc_id", "n_shingles", "node", "bands"])
    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for lo, hi, h, bounds in shingle_sets(batch.column(0), k):
                full = np.diff(bounds) > 0
                if not full.any():
                    continue
                b = np.append(bounds[:-1][full], len(h))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(_set_id(h, b))),
                     pa.ListArray.from_arrays(pa.array(b.astype(np.int32)), pa.array(as_long(h)))],
                    names=["node", "items"])
    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact comparison of ``a, b`` pairs on full sets: adds ``linked``."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb") - both).alias("u"))
            .select("a", "b", (F.col("i") * 100 >= F.col("u") * percent).alias("linked")))


def _split(state: DataFrame) -> DataFrame:
    """Members of buckets that hold several components."""
    split = state.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("w")) \
        .where("x <> y").select("bucket", "w")
    split = written(split, "minhash-split")
    return written(join_weighted(state, split, ["bucket"], "w", "inner").drop("w"), "minhash-open")


def _open_members(state: DataFrame, sets: DataFrame, percent: int, rounds: int = 1) -> DataFrame:
    """Members that may still link to another component of their bucket.

    ``own`` counts the shingles of a set that no open member of another
    component has.  They are in no intersection that matters any more, so a
    set with more than ``100 - percent`` percent of them is finished.
    """
    for _ in range(rounds):
        state = _split(state.drop("own"))
        items = sets.join(state.select("node", "root").distinct(), "node").select("node", "root", F.explode("items").alias("item"))
        items = written(items, "minhash-items")
        common = items.groupBy("item").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("w")) \
            .where("x <> y").select("item", "w")
        common = written(common, "minhash-common")
        shared = join_weighted(items, common, ["item"], "w", "inner").groupBy("node").agg(F.count("*").alias("shared"))
        state = written(state.join(shared, "node").where(F.col("shared") * 100 >= F.col("n") * percent)
                        .withColumn("own", F.col("n") - F.col("shared")).drop("shared"), "minhash-open")
    return _split(state)


def _centred(state: DataFrame) -> DataFrame:
    """Adds ``center``, the member of the bucket with the smallest share of own shingles, and its component."""
    center = state.groupBy("bucket").agg(
        F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "node", "root")).alias("c"), F.count("*").alias("w"))
    center = written(center.select("bucket", F.col("c.node").alias("center"), F.col("c.root").alias("main"), "w"), "minhash-centers")
    return written(join_weighted(state, center, ["bucket"], "w", "inner").drop("w"), "minhash-centred")


def _rerooted(state: DataFrame, labels: DataFrame) -> DataFrame:
    return state.drop("root").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _cross_pairs(state: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of open members of two components that may link: an exact prefix-filtered join.

    Shingles are ordered by rarity among the open members.  Two linked sets
    share a shingle among the first n - need + 1 of each, where need is the
    least intersection any open partner of its buckets allows; what is left
    behind the first shared one bounds the intersection (positional filter).
    """
    least = written(state.groupBy("bucket").agg(F.min("n").alias("least"), F.count("*").alias("w")), "minhash-least")
    nodes = join_weighted(state, least, ["bucket"], "w", "inner").groupBy("node", "root", "n").agg(F.min("least").alias("least"))
    smallest = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    nodes = nodes.withColumn("need", F.ceil((F.col("n") + smallest) * percent / (100 + percent)))
    items = written(sets.join(nodes, "node").select("node", "root", "n", "need", F.explode("items").alias("item")), "minhash-items")
    often = written(items.groupBy("item").agg(F.count("*").alias("w")), "minhash-often")
    place = F.row_number().over(Window.partitionBy("node").orderBy("w", "item")) - 1
    prefix = join_weighted(items, often, ["item"], "w", "inner").withColumn("place", place)
    prefix = written(prefix.where(F.col("place") <= F.col("n") - F.col("need")), "minhash-prefix")
    rest = "least(o.n - o.place, m.n - m.place)"
    return prefix.alias("o").join(prefix.alias("m"), F.expr(
        f"o.item = m.item AND o.root <> m.root AND o.node < m.node "
        f"AND least(o.n, m.n) * 100 >= greatest(o.n, m.n) * {percent} "
        f"AND {rest} * {100 + percent} >= (o.n + m.n) * {percent}")) \
        .select(F.col("o.node").alias("a"), F.col("m.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                    percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked when 100 * |intersection| >= percent * |union| of
    their sets of ``shingle_words``-word shingles; ``component_id`` is the
    smallest id reachable over links, ``kept`` marks that document.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = written(src.mapInArrow(_signatures(shingle_words, bands, rows),
                                    "doc_id long, n_shingles long, node long, bands array<long>"), "minhash-docs")
    nodes = written(signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("n_shingles").alias("n"),
        F.any_value("bands").alias("bands")), "minhash-nodes")

    in_bucket = nodes.select("node", "rep", "n", F.explode("bands").alias("bucket"))
    buckets = in_bucket.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("far"),
                                              F.count("*").alias("w")).where("hub <> far").drop("far")
    buckets = written(buckets, "minhash-buckets")
    members = written(join_weighted(in_bucket, buckets, ["bucket"], "w", "inner").drop("w"), "minhash-members")

    involved = members.select("node", "rep").distinct()
    wanted = involved.select("rep").distinct()
    texts = src.join(wanted, src.doc_id.eqNullSafe(wanted.rep), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(shingle_words), "node long, items array<long>")
    sets = sets.join(involved.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = written(sets, "minhash-sets")

    stars = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    stars = written(_verify(stars, sets, percent), "minhash-stars")
    labels = connected_components(stars.where("linked"))

    rooted = members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted.select("bucket", "node", "root", "n"), "minhash-rooted")
    links, state = stars.where("linked").select("a", "b"), rooted
    for _ in range(CENTER_ROUNDS):
        state = _open_members(state, sets, percent)
        more = _centred(state).where("root <> main").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
        more = written(_verify(more, sets, percent).where("linked").select("a", "b"), "minhash-stars")
        links = links.union(more)
        labels = connected_components(links)
        state = _rerooted(state, labels)
    cross = _cross_pairs(_open_members(state, sets, percent), sets, percent)
    cross = written(_verify(cross, sets, percent).where("linked"), "minhash-cross")
    labels = connected_components(links.union(cross.select("a", "b")))

    info = nodes.select("node", "rep", "copies").join(labels, "node", "left") \
        .withColumn("root", F.coalesce("root", "node"))
    roots = info.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("w"))
    info = join_weighted(info, written(roots, "minhash-roots"), ["root"], "w", "inner") \
        .select("node", "component_id", "copies")
    found = join_weighted(signed.select("doc_id", "n_shingles", "node").where("node IS NOT NULL"),
                          written(info, "minhash-info"), ["node"], "copies", "inner")
    alone = signed.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "n_shingles", "component_id").unionByName(alone) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
