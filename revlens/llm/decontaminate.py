"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (a
shorter item is one window).  A window is the set of its word shingles; a
document contains the window only if it contains all of them, so with the
shingles ordered by rarity over all documents one -- the rarest -- is the
necessary prefix.  Only those prefix shingles are joined:

1. one pass over the texts counts the benchmark's shingles in the corpus
   (rarity); windows with a shingle that occurs nowhere are dropped;
2. a second pass emits, for each occurrence of a prefix shingle, the words
   around it;
3. the join on the shingle gives candidate placements; the positional bound
   (the window must begin and end inside the document) drops some, and the
   others are verified word by word.

Both passes skip words by a bitmap of fixed size of the benchmark's shingle
hashes, so what is shuffled follows the benchmark's occurrences, not the
corpus.  A benchmark of any size gives right results; it only fills the bitmap.

Defined results: NULL or wordless texts and items have no words and match
nothing; repeated item ids count once per document; rows that repeat a doc_id
are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.shuffle_tools import join_salted, row_key, written
from revlens.llm.text_kernel import ALNUM, as_long, row_slices, shingle_hashes, text_bytes, words_of

WINDOW = 13
SHINGLE = 5
#: Bits of the hash bitmap that both passes carry: 2 MB, whatever the benchmark.
BITMAP_BITS = 1 << 24


def _words(column):
    buf, offsets = text_bytes(column)
    for lo, hi in row_slices(offsets):
        yield lo, hi, words_of(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1], ALNUM)


def _windows(window: int, shingle: int):
    def run(batches):
        for batch in batches:
            for lo, hi, w in _words(batch.column(1)):
                rows, texts, sizes, shingles = [], [], [], []
                by_k = {}
                for r, n in enumerate(w.counts.tolist()):
                    size = min(n, window)
                    if not size:
                        continue
                    k = min(shingle, size)
                    if k not in by_k:
                        h, at = shingle_hashes(w, k)
                        by_k[k] = dict(zip(at.tolist(), as_long(h).tolist()))
                    for s in range(w.first[r], w.first[r + 1] - size + 1):
                        rows.append(lo + r)
                        texts.append(w.text(s, s + size))
                        sizes.append(size)
                        shingles.append([by_k[k][x] for x in range(s, s + size - k + 1)])
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array(texts), pa.array(sizes, pa.int32()),
                         pa.array(shingles, pa.list_(pa.int64()))], names=["item_id", "win", "size", "shingles"])
    return run


def _bitmap(spark, hashes: DataFrame):
    """Broadcast bitmap of the hashes modulo BITMAP_BITS (at most that many positions reach the driver)."""
    at = hashes.select(F.pmod("shingle", F.lit(BITMAP_BITS)).cast("int").alias("b")).distinct().toArrow()["b"].to_numpy()
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return spark.sparkContext.broadcast(bits)


def _hits(w, sizes, bits):
    """Shingle size, hashes and first words of the occurrences that may be wanted."""
    for k in sizes:
        h, at = shingle_hashes(w, k)
        b = h & np.uint64(BITMAP_BITS - 1)
        some = (bits[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1
        some = np.flatnonzero(some)
        yield k, as_long(h[some]), at[some]


def _count(sizes, bitmap):
    def run(batches):
        for batch in batches:
            found = [h for _, _, w in _words(batch.column(0)) for _, h, _ in _hits(w, sizes, bitmap.value)]
            if found:
                values, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["shingle", "n"])
    return run


def _contexts(sizes, bitmap, window: int):
    """One row per document (n_words) and one per occurrence (shingle, its first word, the words around it)."""
    names = ["key", "doc_id", "n_words", "shingle", "pos", "left", "context"]

    def run(batches):
        for batch in batches:
            for lo, hi, w in _words(batch.column(1)):
                keys, ids = (batch.column(i).slice(lo, hi - lo) for i in (2, 0))
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [keys, ids, pa.array(w.counts), none, none, none, pa.nulls(hi - lo, pa.string())], names=names)
                for k, h, at in _hits(w, sizes, bitmap.value):
                    if not len(at):
                        continue
                    row = np.searchsorted(w.first, at, "right") - 1
                    a = np.maximum(w.first[row], at - window + 1)
                    b = np.minimum(w.first[row + 1], at + window)
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(row)), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.array(h), pa.array(at - w.first[row]),
                         pa.array(at - a), pa.array([w.text(x, y) for x, y in zip(a.tolist(), b.tolist())])], names=names)
    return run


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                  share: int = 20) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``.

    A word is hit inside any occurrence of a window; a document is contaminated
    when hit words are at least one in ``share`` of its words.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("key", row_key("doc_id", "text"))
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = written(items.mapInArrow(_windows(window, shingle), "item_id string, win string, size int, shingles array<long>")
                      .dropDuplicates(["item_id", "win"]), "decon-windows")
    sets = windows.dropDuplicates(["win"]).select("win", "size", "shingles")
    sizes = [r["k"] for r in sets.select(F.least("size", F.lit(shingle)).alias("k")).distinct().collect()]  # at most ``shingle``

    tokens = sets.select("win", "size", F.posexplode("shingles").alias("place", "shingle"))
    seen = docs.select("text").mapInArrow(_count(sizes, _bitmap(spark, tokens)), "shingle long, n long") \
        .groupBy("shingle").agg(F.sum("n").alias("n"))
    ranked = tokens.join(seen, "shingle", "left").groupBy("win", "size").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "place")).alias("rarest"))
    prefix = written(ranked.where("rarest.n > 0").select(
        "win", "size", "rarest.shingle", "rarest.place", F.col("rarest.n").alias("w")), "decon-prefix")

    found = written(docs.mapInArrow(_contexts(sizes, _bitmap(spark, prefix), window),
                                    "key long, doc_id long, n_words long, shingle long, pos long, left long, context string"), "decon-found")
    words = F.split("context", " ")
    near = found.where("shingle IS NOT NULL").select("key", "shingle", "pos", "left", "context")
    placed = (join_salted(near, prefix, ["shingle"], "w", ["key", "pos"])
              .where((F.col("left") >= F.col("place")) & (F.size(words) >= F.col("left") - F.col("place") + F.col("size")))
              .where(F.slice(words, (F.col("left") - F.col("place") + 1).cast("int"), F.col("size")) == F.split("win", " "))
              .select("key", "win", "size", (F.col("pos") - F.col("place")).alias("start")))
    placed = written(placed.distinct(), "decon-placed")

    # words covered: by ascending start, what each placement adds beyond the furthest end so far
    spans = placed.select("key", "start", (F.col("start") + F.col("size")).alias("end")) \
        .groupBy("key", "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(0))
    hit = spans.withColumn("add", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reach))) \
        .groupBy("key").agg(F.sum("add").alias("n_hit"))
    uses = written(placed.select("key", "win").distinct(), "decon-uses")
    often = uses.groupBy("win").agg(F.count("*").alias("w"))
    owners = written(windows.select("win", "item_id").join(often, "win"), "decon-owners")
    items_of = join_salted(uses, owners, ["win"], "w", ["key"]) \
        .groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    per_row = hit.join(items_of, "key")
    every = found.where("n_words IS NOT NULL").select("key", "doc_id", "n_words")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    return every.join(per_row, "key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", none)), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))
