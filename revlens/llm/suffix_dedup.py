"""Removal of repeated byte strings by distributed bucket-pointer refinement.

A byte is removed when a string of ``span`` bytes that covers it also starts
anywhere else, in any document.  Suffixes are put in buckets and the buckets
refined until suffixes in one bucket agree on ``span`` bytes:

1. *Initial q-gram buckets.*  For each start only the q-gram with the smallest
   hash among those inside its string (its anchor) is bucketed.  Equal strings
   have equal anchors at equal places, so the bucket of the anchor's q-gram
   holds all strings equal to it.  Consecutive starts share their anchor: one
   row stands for a run of starts, and the bytes of all of them together are
   the run's context.
2. *Refinement on later offsets.*  The pointer of a run is its bucket; runs of
   a bucket are sorted on the identifier of their whole context.  Equal
   contexts repeat in full.  A bucket with one context is finished.  In the
   others the runs are cut into slices of starts (48, then 6, then 1), and a
   slice's new pointer is its old pointer and the identifier of the bytes
   common to all its strings, which begin at a later offset.  Slices alone in
   their bucket are finished, slices whose whole bytes occur twice repeat in
   full, and only the rest goes on, from the refined pointers.  A slice of one
   start is decided by its bucket alone.

Every step groups by identifiers with map-side sums, so a passage in a third
of all documents is a counter, not a group in one task.  Identifiers are
64-bit hashes of the bytes.

Defined results: a NULL text is empty; texts under ``span`` bytes lose
nothing; rows that repeat a doc_id are judged one by one (identical rows
repeat each other); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.shuffle_tools import join_weighted, written
from revlens.llm.text_kernel import SLICE_BYTES, as_long, mix64, row_slices, text_bytes

SPAN = 400
GRAM = 100
SLICES = (48, 6, 1)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(8).integers(1, 2**63, 256).astype(np.uint64)
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, kept per worker."""
    if not _tables or len(_tables[0]) < n:
        _tables.clear()
        for base in (_BASE, _INVERSE):
            p = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _tables.append(p)
    return _tables[0][:n], _tables[1][:n]


class Identifiers:
    """Identifier of any substring of ``buf`` in constant time (prefix sums modulo 2**64)."""

    def __init__(self, buf: np.ndarray):
        power, self.inverse = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, in a fixed number of passes."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1:w - 1 + n])


def anchored_runs(buf: np.ndarray, offsets: np.ndarray, span: int, gram: int):
    """Runs of starts with one anchor: ``row, anchor, lo, hi`` (places in the row), bucket and context identifiers."""
    n = len(buf)
    if n < span:
        return None
    ident = Identifiers(buf)
    at = np.arange(n - gram + 1)
    gram_id = ident.of(at, at + gram)
    key = (gram_id & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # leftmost on ties
    owner = (_window_min(key, span - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    room = np.diff(offsets) - span + 1
    rows = np.flatnonzero(room > 0)
    if not len(rows):
        return None
    room = room[rows]
    first = np.cumsum(room) - room
    row = np.repeat(rows, room)
    start = np.arange(int(room.sum())) - np.repeat(first, room) + offsets[row]
    owner = owner[start]
    cut = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])))
    last = np.append(cut[1:], len(start)) - 1
    lo, hi, anchor, row = start[cut], start[last], owner[cut], row[cut]
    context = mix64(ident.of(lo, hi + span) + (anchor - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    base = offsets[row]
    return row, anchor - base, lo - base, hi - base, gram_id[anchor], context


def _pieces(offsets: np.ndarray, span: int):
    """Byte ranges to look at together: ``(row, byte range, row bounds in it, place of the range in its row)``.

    Short rows come together; a longer row comes in pieces that overlap by
    span - 1 bytes, so each of its starts is in exactly one piece.
    """
    for lo, hi in row_slices(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or b - a <= SLICE_BYTES:
            yield lo, a, b, offsets[lo:hi + 1] - a, 0
            continue
        for s in range(0, b - a - span + 1, SLICE_BYTES):
            e = min(s + SLICE_BYTES + span - 1, b - a)
            yield lo, a + s, a + e, np.array([0, e - s]), s


def _runs(span: int, gram: int):
    def run(batches):
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for row0, a, b, bounds, place in _pieces(offsets, span):
                found = anchored_runs(buf[a:b], bounds, span, gram)
                if found is None:
                    continue
                row, anchor, lo, hi, bucket, context = found
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + row0)), pa.array(anchor + place), pa.array((lo + place)),
                     pa.array(hi + place), pa.array(as_long(bucket)), pa.array(as_long(context))],
                    names=["uid", "anchor", "lo", "hi", "bucket", "context"])
    return run


def _contexts(span: int):
    """Bytes of the runs asked for, from the texts they lie in."""
    def run(batches):
        for batch in batches:
            buf, offsets = text_bytes(batch.column(0))
            wanted = batch.column(1)
            sizes = pa.compute.list_value_length(wanted).to_numpy(zero_copy_only=False)
            flat = wanted.flatten()
            anchor, lo, hi = (flat.field(f).to_numpy() for f in ("anchor", "lo", "hi"))
            base = np.repeat(offsets[:-1], sizes)
            for at in range(0, len(lo), 4096):
                cut = slice(at, at + 4096)
                data = [buf[s:e].tobytes() for s, e in zip((base + lo)[cut].tolist(), (base + hi + span)[cut].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [flat.field("bucket").slice(at, 4096), flat.field("context").slice(at, 4096),
                     pa.array((lo - anchor)[cut], pa.int32()), pa.array((hi - anchor)[cut], pa.int32()), pa.array(data, pa.binary())],
                    names=["pointer", "context", "lo", "hi", "bytes"])
    return run


def _slices(span: int, gram: int, size: int, parent: int | None):
    """Slices of ``size`` starts of each context (inside the ``parent``-sized slices given, if any) and their identifiers."""
    origin = -((span - gram) // SLICES[0] + 1) * SLICES[0]

    def run(batches):
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            buf, offsets = text_bytes_of_binary(col["bytes"])
            lo, hi = (col[c].to_numpy().astype(np.int64) for c in ("lo", "hi"))
            if parent is None:
                row = np.arange(len(lo))
                first, last, pointer = lo, hi, col["pointer"].to_numpy()
            else:
                sizes = pa.compute.list_value_length(col["slices"]).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lo)), sizes)
                at = col["slices"].flatten()
                k = at.field("at").to_numpy().astype(np.int64)
                first, last = np.maximum(lo[row], k), np.minimum(hi[row], k + parent - 1)
                pointer = at.field("pointer").to_numpy()
            j0, j1 = (first - origin) // size, (last - origin) // size
            many = j1 - j0 + 1
            which = np.repeat(np.arange(len(row)), many)
            j = j0[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            r = row[which]
            k = origin + j * size
            a, b = np.maximum(first[which], k), np.minimum(last[which], k + size - 1)
            base = offsets[:-1][r] - lo[r]
            ident = Identifiers(buf)
            # the bytes in all strings of the whole slice, also of starts that other runs have in it
            core = ident.of(base + k + size - 1, base + k + span)
            whole = mix64(ident.of(base + a, base + b + span) + (a - k).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
            new = mix64(core ^ mix64(pointer[which].astype(np.int64).view(np.uint64) + k.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [col["context"].take(pa.array(r)), col["bucket"].take(pa.array(r)), pa.array(k, pa.int32()), pa.array(a, pa.int32()),
                 pa.array(b, pa.int32()), pa.array(as_long(new)), pa.array(as_long(whole))],
                names=["context", "bucket", "at", "first", "last", "pointer", "whole"])
    return run


def text_bytes_of_binary(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without NULLs."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def repeated_starts(src: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``uid, first, last``: ranges of starts whose ``span`` bytes start elsewhere too (src: uid, text)."""
    runs = written(src.select("uid", "text").mapInArrow(
        _runs(span, gram), "uid long, anchor long, lo long, hi long, bucket long, context long"), "suffix-runs")
    contexts = written(runs.groupBy("bucket", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("uid", "anchor", "lo", "hi")).alias("at")), "suffix-contexts")
    buckets = contexts.groupBy("bucket").agg(F.min("context").alias("x"), F.max("context").alias("y"), F.count("*").alias("w")) \
        .where("x <> y").select("bucket", "w")
    open_contexts = join_weighted(contexts, written(buckets, "suffix-buckets"), ["bucket"], "w", "inner")
    asked = open_contexts.select(F.col("at.uid").alias("uid"), F.struct(
        "at.anchor", "at.lo", "at.hi", "bucket", "context").alias("run")).groupBy("uid").agg(F.collect_list("run").alias("runs"))
    held = src.join(asked, "uid").select("text", "runs").mapInArrow(
        _contexts(span), "pointer long, context long, lo int, hi int, bytes binary")
    held = written(held.withColumn("bucket", F.col("pointer")), "suffix-bytes")

    found = [contexts.where("n > 1").select("bucket", "context", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))]
    work, parent = held, None
    for size in SLICES:
        rows = written(work.mapInArrow(_slices(span, gram, size, parent),
                       "context long, bucket long, at int, first int, last int, pointer long, whole long"), "suffix-slices")
        two = F.min("context") != F.max("context")
        equal = rows.groupBy("pointer", "whole").agg(F.min("context").alias("x"), F.max("context").alias("y"), F.count("*").alias("w"))
        if size == 1:  # the slice is one string: the bucket decides
            equal = rows.groupBy("pointer").agg(two.alias("repeats"), F.count("*").alias("w"))
            equal = written(equal.where("repeats").select("pointer", "w"), "suffix-pointers")
            found.append(join_weighted(rows, equal, ["pointer"], "w", "inner").select("bucket", "context", "first", "last"))
            break
        equal = written(equal, "suffix-equal")
        shared = equal.groupBy("pointer").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.sum("w").alias("w"),
                                                F.count("*").alias("kinds")).where("x <> y")
        shared = written(shared.select("pointer", "kinds", "w"), "suffix-pointers")
        left = join_weighted(rows, shared, ["pointer"], "w", "inner").drop("w")
        both = written(equal.where("x <> y").select("pointer", "whole", "x", "w"), "suffix-repeats")
        left = written(join_weighted(left, both, ["pointer", "whole"], "w", "left"), "suffix-left")
        found.append(left.where("w IS NOT NULL").select("bucket", "context", "first", "last"))
        # of the slices that are equal as a whole one goes on, for others of the bucket to meet
        go_on = left.where("kinds > 1 AND (w IS NULL OR context = x)").groupBy("bucket", "context").agg(
            F.collect_set(F.struct("at", "pointer")).alias("slices"))
        work = held.drop("pointer").join(go_on, ["bucket", "context"])  # the bytes were written once
        parent = size
    ranges = found[0]
    for f in found[1:]:
        ranges = ranges.unionByName(f)
    # at most one range per start and context
    ranges = ranges.groupBy("bucket", "context").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    ranges = written(ranges.join(contexts.select("bucket", "context", "n"), ["bucket", "context"]), "suffix-ranges")
    hits = join_weighted(runs, ranges, ["bucket", "context"], "n", "inner").select("uid", "anchor", "lo", "hi", F.explode("ranges").alias("r"))
    return hits.select("uid", F.coalesce(F.col("anchor") + F.col("r.first"), "lo").alias("first"),
                       F.coalesce(F.col("anchor") + F.col("r.last"), "hi").alias("last")).distinct()


def _cut(span: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                buf, offsets = text_bytes(part.column(1))
                kept, spans, removed = [], [], []
                for r, ranges in enumerate(part.column(2).to_pylist()):
                    text = buf[offsets[r]:offsets[r + 1]]
                    runs: list[list[int]] = []
                    for a, b in sorted((x["first"], x["last"] + span) for x in ranges or ()):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                    keep = np.ones(len(text), bool)
                    for a, b in runs:
                        keep[a:b] = False
                    kept.append(text[keep].tobytes())
                    spans.append([{"start": a, "end": b} for a, b in runs])
                    removed.append(int((~keep).sum()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])
    return run


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans array<struct<start, end>>, kept binary`` for every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")) \
        .withColumn("uid", F.xxhash64("doc_id", "text"))
    starts = repeated_starts(src, span, gram).groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    return src.join(starts, "uid", "left").select("doc_id", "text", "ranges").mapInArrow(
        _cut(span), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
