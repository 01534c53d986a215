"""Phrase collocation mining by dynamic itemset counting.

The documents are dealt to ``SHARDS`` shards that are scanned in a cycle, one
shard a step.  Words are counted from step 0 on.  A phrase of 2 to 5 words is
activated at the first step after both its subphrases (all words but the last,
all but the first) have reached the threshold, whatever its length, and is
then counted for exactly one full cycle, so every count is complete; lengths
are interleaved: one scan counts active phrases of every length.

Each step is three Spark jobs over written tables:

1. the shard's words are scanned; which phrases may be active is looked up in
   two bitmaps of fixed size (``FILTER_BITS`` bits each, broadcast): hashes of
   phrases that have reached the threshold, and of those that did so within the
   last cycle.  A bitmap has no false negatives.  Counts are summed per task,
   then by phrase, and appended to a table bucketed by phrase;
2. sums over the last cycle (bucketed: no shuffle) give the few phrases that
   may have just reached the threshold; joins with their subphrases give the
   exact step of activation, so counts made early because of a false positive
   are left out;
3. the bitmaps' new bits come to the driver (at most ``FILTER_BITS / 64`` numbers).

The bitmaps only save work: once they fill up (tens of millions of frequent
phrases at the default size), more phrases are counted than necessary.

A word is identified by a 64-bit hash of itself and its language, a phrase by
those of its words.  Defined results: NULL and empty texts have no words; a
NULL ``lang`` is ``und``; repeated rows and repeated ids count each time; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.shuffle_tools import written
from revlens.llm.text_kernel import gathered, mix64, row_slices, text_bytes, words_of
from revlens.session import scratch_path

SHARDS = 3
THRESHOLD = 100
LONGEST = 5
FILTER_BITS = 1 << 24
#: Positions counted at once by a task (about 100 bytes each), and words in a row of the token table.
COUNTED_AT_ONCE = 2_000_000
ROW_WORDS = 250_000

_U = np.uint64
_BREAKS = np.array([b in b".,;:!?\n\x0b\x0c\r" for b in range(256)])
_WORD = np.array([b not in b" \t" for b in range(256)]) & ~_BREAKS
_NEXT = _U(0xD6E8FEB86659FD93)


def _identified(batch: pa.RecordBatch):
    """For slices of the rows: words, their ids, the row of each, shards and languages of the rows."""
    buf, offsets = text_bytes(batch.column("text"))
    shards = batch.column("shard").to_numpy(zero_copy_only=False)
    langs = batch.column("lang").to_pylist()
    salt = {x: int.from_bytes(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in set(langs)}
    salts = np.array([salt[x] for x in langs], _U)
    for lo, hi in row_slices(offsets):
        words = words_of(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1], _WORD)
        row = np.repeat(np.arange(hi - lo), words.counts)
        ids = mix64(words.hash ^ salts[lo:hi][row])
        ids[ids == 0] = 1
        yield words, ids, row, shards[lo:hi], langs[lo:hi]


def _binary(data: np.ndarray, width: int) -> pa.Array:
    """Binary values of ``width`` bytes each."""
    n = data.nbytes // width if width else 0
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _word_counts(shards: int):
    """Map: rows -> language, word, id and its count in each shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, ids, row, shard, langs in _identified(batch):
                if not len(ids):
                    continue
                found, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
                counts = np.bincount(inverse * shards + shard[row], minlength=len(found) * shards).reshape(-1, shards)
                data, at = gathered(words.buf, words.start[first], words.end[first])
                text = pa.Array.from_buffers(pa.string(), len(found), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
                lang = pa.array(langs, pa.string()).take(pa.array(row[first]))
                yield pa.RecordBatch.from_arrays(
                    [lang, text, _binary(found, 8)] + [pa.array(counts[:, i].astype(np.int64)) for i in range(shards)],
                    names=["lang", "word", "words"] + [f"c{i}" for i in range(shards)])
    return run


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map: rows -> shard, language, number of words, and the word ids with a 0 behind every piece."""
    for batch in batches:
        for words, ids, row, shard, langs in _identified(batch):
            if not len(ids):
                continue
            piece = np.cumsum(_BREAKS[words.buf], dtype=np.int64)[words.start]
            last = np.ones(len(ids), bool)
            last[:-1] = (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])
            names = sorted(set(langs))
            group = shard[row].astype(np.int64) * len(names) + np.array([names.index(x) for x in langs])[row]
            out = []
            for g in np.unique(group):
                mine = group == g
                tokens, ends = ids[mine], last[mine]
                place = np.arange(len(tokens)) + np.cumsum(ends) - ends
                stream = np.zeros(len(tokens) + int(ends.sum()), _U)
                stream[place] = tokens
                lo = 0
                while lo < len(stream):  # rows end behind a piece
                    zero = np.flatnonzero(stream[lo + ROW_WORDS:] == 0)[:1] if lo + ROW_WORDS < len(stream) else ()
                    hi = lo + ROW_WORDS + int(zero[0]) + 1 if len(zero) else len(stream)
                    part = stream[lo:hi]
                    out.append((int(g) // len(names), names[int(g) % len(names)], int(np.count_nonzero(part)), part.tobytes()))
                    lo = hi
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string()),
                 pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.binary())],
                names=["shard", "lang", "n", "tokens"])


def phrase_hashes(grams: np.ndarray) -> np.ndarray:
    """Hash of each row of word ids (n x k); a single word is its own hash."""
    h = grams[:, 0].copy()
    for j in range(1, grams.shape[1]):
        h = mix64(h * _NEXT + grams[:, j])
    return h


def _bits(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & _U(len(bitmap) * 64 - 1)
    return (bitmap[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1


def active_positions(w: np.ndarray, reached: np.ndarray, recent: np.ndarray, longest: int):
    """For k = 2 .. longest: starts of k-word phrases that may be active, and their hashes.

    A phrase counts where both subphrases have reached the threshold and at
    least one of them did so within the last cycle.
    """
    hashes, ok, new = w, _bits(reached, w) & (w != 0), _bits(recent, w)
    for k in range(2, longest + 1):
        n = len(w) - k + 1
        if n <= 0:
            return
        at = np.flatnonzero(ok[:n] & ok[1:n + 1])
        if not len(at):
            return
        h = mix64(hashes[at] * _NEXT + w[at + k - 1])
        active = new[at] | new[at + 1]
        yield k, at[active], h[active]
        hashes = np.zeros(n, _U)
        hashes[at] = h
        ok, before = np.zeros(n, bool), new
        ok[at] = _bits(reached, h)
        new = np.zeros(n, bool)
        new[at] = _bits(recent, h)


def _phrase_counts(bitmaps, longest: int):
    """Map: token rows -> phrases that may be active and their counts, summed over the task's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, recent = (np.frombuffer(x, _U) for x in bitmaps.value)
        held: dict[int, list] = {}
        size = 0

        def summed():
            for k, parts in held.items():
                hashes = np.concatenate([h for h, _ in parts])
                grams = np.concatenate([g for _, g in parts])
                _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
                for lo in range(0, len(first), 1 << 18):
                    yield pa.RecordBatch.from_arrays(
                        [_binary(grams[first[lo:lo + (1 << 18)]], 8 * k), pa.array(counts[lo:lo + (1 << 18)].astype(np.int64))],
                        names=["words", "cnt"])
            held.clear()

        for batch in batches:
            for tokens in batch.column("tokens"):
                w = np.frombuffer(tokens.as_buffer(), _U)
                for k, at, h in active_positions(w, reached, recent, longest):
                    if len(at):
                        held.setdefault(k, []).append((h, w[at[:, None] + np.arange(k)]))
                        size += len(at)
                if size >= COUNTED_AT_ONCE:
                    yield from summed()
                    size = 0
        yield from summed()
    return run


def _set_bits(bits: int):
    """Map: phrases -> numbers of 64 bits each of a bitmap, and the bits set in them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(x.as_buffer(), _U) for x in batch.column("words")]
            by_size: dict[int, list] = {}
            for v in values:
                by_size.setdefault(len(v), []).append(v)
            for grams in by_size.values():
                at = phrase_hashes(np.stack(grams)) & _U(bits - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((at >> _U(6)).astype(np.int64)), pa.array((_U(1) << (at & _U(63))).view(np.int64))], names=["place", "bits"])
    return run


def _bitmap(phrases: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the phrases' hashes; its non-zero numbers come to the driver, at most bits / 64 of them."""
    out = np.zeros(bits // 64, np.int64)
    found = phrases.select("words").mapInArrow(_set_bits(bits), "place long, bits long") \
        .groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[found["place"].to_numpy()] = found["bits"].to_numpy()
    return out.view(_U)


def _counted(spark: SparkSession, docs: DataFrame, shards: int, threshold: int, longest: int, bits: int):
    """Words (lang, word, words, a, step) and phrases (words, a) that reach the threshold, and n of each language."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text",
                       F.pmod(F.xxhash64("lang", "text"), F.lit(shards)).cast("int").alias("shard"))
    schema = "lang string, word string, words binary" + "".join(f", c{i} long" for i in range(shards))
    by_shard = rows.mapInArrow(_word_counts(shards), schema).groupBy("lang", "word") \
        .agg(F.first("words").alias("words"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(shards)])
    upto = [sum((F.col(f"c{j}") for j in range(i + 1)), F.lit(0)) for i in range(shards)]
    step = F.coalesce(*[F.when(upto[i] >= threshold, F.lit(i)) for i in range(shards)])
    words = written(by_shard.select("lang", "word", "words", upto[-1].alias("a"), step.alias("step")).where("step IS NOT NULL"), "dic-words")

    path = scratch_path(spark, "dic-tokens")
    rows.mapInArrow(_token_rows, "shard int, lang string, n long, tokens binary") \
        .write.partitionBy("shard").option("compression", "zstd").parquet(path)
    tokens = spark.read.schema("lang string, n long, tokens binary, shard int").parquet(path)
    totals = written(tokens.groupBy("lang").agg(F.sum("n").alias("n")), "dic-totals")

    counts = f"dic_{uuid.uuid4().hex[:12]}"  # bucketed by phrase: sums over steps need no shuffle
    counts_path = scratch_path(spark, "dic-counts")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reached_path = scratch_path(spark, "dic-reached")
    words.select("words", F.lit(-1).alias("act"), "step").write.parquet(reached_path)

    def reached():
        return spark.read.schema("words binary, act int, step int").parquet(reached_path)

    new = {i: _bitmap(words.where(F.col("step") == i), bits) for i in range(shards)}
    last = max((i for i in new if new[i].any()), default=-shards)
    try:
        step = 0
        while (step := step + 1) <= last + shards:
            before = [new[i] for i in range(step) if i in new]
            recent = [new[i] for i in range(max(0, step - shards), step) if i in new]
            maps = spark.sparkContext.broadcast(tuple(np.bitwise_or.reduce(x).tobytes() for x in (before, recent)))
            shard = tokens.where(F.col("shard") == step % shards).select("tokens")
            shard.mapInArrow(_phrase_counts(maps, longest), "words binary, cnt long") \
                .groupBy("words").agg(F.sum("cnt").alias("cnt")).withColumn("step", F.lit(step)) \
                .write.mode("append").bucketBy(buckets, "words").option("path", counts_path) \
                .option("compression", "zstd").saveAsTable(counts)
            maps.destroy()
            _newly_reached(spark.table(counts), reached(), step, shards, threshold) \
                .write.mode("append").parquet(reached_path)
            shorter = F.length("words") < 8 * longest  # the longest activate nothing
            bitmap = _bitmap(reached().where((F.col("step") == step) & (F.col("act") >= 0) & shorter), bits)
            new[step] = new[step] | bitmap if step in new else bitmap
            last = step if bitmap.any() else last
        every = reached().where(F.col("act") >= 0).select("words", "act")
        if last > -shards:
            phrases = spark.table(counts).withColumnRenamed("step", "at").join(every.hint("shuffle_merge"), "words") \
                .where((F.col("at") >= F.col("act")) & (F.col("at") < F.col("act") + shards)) \
                .groupBy("words").agg(F.sum("cnt").alias("a"))
        else:
            phrases = every.select("words", F.lit(0).cast("long").alias("a"))
        return words, written(phrases, "dic-phrases"), totals
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {counts}")


def _newly_reached(counts: DataFrame, reached: DataFrame, step: int, shards: int, threshold: int) -> DataFrame:
    """Phrases whose count since activation passes the threshold at ``step``: words, act, step."""
    window = range(max(1, step - shards + 1), step + 1)
    sums = ", ".join(f"coalesce(sum(CASE WHEN step = {s} THEN cnt END), 0) AS s{s}" for s in window)
    upto = " + ".join(f"CASE WHEN act <= {s} THEN s{s} ELSE 0 END" for s in window)
    return counts.sparkSession.sql(f"""
        WITH sums AS (SELECT words, sum(cnt) AS total, {sums} FROM {{counts}} WHERE step > {step - shards} GROUP BY words),
        high AS (SELECT *, substring(words, 1, length(words) - 8) AS head, substring(words, 9, length(words) - 8) AS tail
                 FROM sums WHERE total >= {threshold} AND s{step} > 0),
        known AS (SELECT h.*, greatest(a.step, b.step) + 1 AS act FROM high h
                  JOIN {{reached}} a ON h.head = a.words JOIN {{reached}} b ON h.tail = b.words)
        SELECT words, act, {step} AS step FROM known
        WHERE act + {shards} > {step} AND {upto} >= {threshold} AND {upto} - s{step} < {threshold}""",
        counts=counts, reached=reached.where(f"step < {step}"))


def collocations(docs: DataFrame, top: int | None = 2000, shards: int = SHARDS, threshold: int = THRESHOLD,
                 longest: int = LONGEST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The ``top`` best phrases of each language (None: all): lang, rank, phrase, a, l, r, n, score.

    ``docs`` has ``lang`` and ``text``.  The score is the lowest of all cuts of
    floor(1000 a n / (l r)), in exact decimal arithmetic.  Phrases whose count
    equals that of a longer candidate they lie in are left out: a candidate
    that lies in one with at least its own count lies in one of just one word
    more with the same count, because counts never grow with length.
    """
    spark = docs.sparkSession
    words, phrases, totals = _counted(spark, docs, shards, threshold, longest, filter_bits)
    size = (F.length("words") / 8).cast("int")
    longer = phrases.where(F.length("words") > 16)
    inside = longer.select(F.expr("substring(words, 1, length(words) - 8)").alias("words"), "a") \
        .union(longer.select(F.expr("substring(words, 9, length(words) - 8)").alias("words"), "a")).distinct()
    left = phrases.join(inside, ["words", "a"], "left_anti")

    named = left.select("words", "a", F.posexplode(F.sequence(F.lit(0), size - 1)).alias("pos", "i")) \
        .withColumn("word_id", F.expr("substring(words, 8 * i + 1, 8)")) \
        .join(words.select(F.col("words").alias("word_id"), "word", "lang"), "word_id") \
        .groupBy("words", "a").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w")) \
        .select("words", "a", "lang", F.array_join("w.word", " ").alias("phrase"))

    counts = phrases.unionByName(words.select("words", "a"))
    cuts = left.join(totals_by_phrase(named, totals), "words") \
        .select("words", "a", "lang", "phrase", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")) \
        .withColumn("head", F.expr("substring(words, 1, 8 * k)")).withColumn("tail", F.expr("substring(words, 8 * k + 1, length(words))")) \
        .join(counts.select(F.col("words").alias("head"), F.col("a").alias("l")), "head") \
        .join(counts.select(F.col("words").alias("tail"), F.col("a").alias("r")), "tail") \
        .withColumn("score", F.expr("(cast(a as decimal(19, 0)) * 1000 * cast(n as decimal(15, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    lowest = cuts.groupBy("words", "a", "lang", "phrase", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")) \
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = lowest.withColumn("rank", F.row_number().over(order).cast("long"))
    return (ranked.where(F.col("rank") <= top) if top else ranked).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def totals_by_phrase(named: DataFrame, totals: DataFrame) -> DataFrame:
    """``words, lang, phrase, n``: the number of words of each phrase's language."""
    return named.join(totals, "lang").select("words", "lang", "phrase", "n")
