"""Token ids in compact binary segments: canonical length-limited Huffman codes.

1. Texts are encoded and the ids kept in a written table (16- or 32-bit).
2. Global id counts are summed by Spark (at most one row per id reaches the
   driver) and turned into code lengths of at most ``MAX_BITS`` by
   package-merge; codes are canonical, so the lengths are the whole table.
3. Every document becomes a bit string cut into blocks of ``BLOCK`` ids with
   a bit offset per block.  Documents are dealt to ranges of ascending doc_id,
   sorted, and written as segments.  A segment is one self-contained binary
   value: header, document index, block checkpoints, bits.
4. Reading back looks each window of ``MAX_BITS`` bits up in one table
   (id and length); all blocks of a segment are decoded side by side.

Segments are rows of a Parquet table, written and read by Spark, so any
storage that Spark reaches holds them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.shuffle_tools import written
from revlens.llm.tokens import encoder
from revlens.session import scratch_path

MAX_BITS = 18
BLOCK = 256
#: Ids in a segment before the next one starts.
SEGMENT_IDS = 1 << 20
#: Ranges of doc_id, at most; their totals are collected for the running start.
MAX_RANGES = 4096
#: Rows of one range, about.
RANGE_ROWS = 20_000

MAGIC = b"HTOK"
_HEAD = struct.Struct("<4sBHqII")  # magic, max bits, block size, ids before, documents, blocks


# --- codes -------------------------------------------------------------------

def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge); 0 for unused ids."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 0:
        return lengths
    if n == 1:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need more than {max_bits} bits")
    order = used[np.lexsort((used, counts[used]))]
    weight = counts[order].astype(np.int64)
    level, is_leaf = weight, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        m = len(level) // 2 * 2
        packages = level[0:m:2] + level[1:m:2]
        both = np.concatenate([weight, packages])
        leaf = np.concatenate([np.ones(n, bool), np.zeros(len(packages), bool)])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        is_leaf.append(leaf[rank])
    take = 2 * n - 2
    depth = np.zeros(n, np.int64)
    for leaf in reversed(is_leaf):
        leaves = int(leaf[:take].sum())
        depth[:leaves] += 1  # leaves come in order of weight, so the first ones are taken
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id), each the previous plus one, shifted on a longer length."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    used = np.flatnonzero(lengths)
    by_length = np.bincount(lengths[used], minlength=2)
    for bits in range(1, len(by_length)):
        code <<= bits - last
        last = bits
        ids = used[lengths[used] == bits]
        codes[ids] = code + np.arange(len(ids))
        code += len(ids)
    return codes


def decode_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``max_bits`` bits: the id it starts with, and its length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = np.int64(1) << (max_bits - lengths[order].astype(np.int64))
    ids = np.zeros(1 << max_bits, np.uint32)
    bits = np.zeros(1 << max_bits, np.uint8)
    filled = int(spans.sum())
    ids[:filled] = np.repeat(order, spans)
    bits[:filled] = np.repeat(lengths[order], spans)
    return ids, bits


# --- documents and segments ----------------------------------------------------

def pack_bits(ids: np.ndarray, first: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bits of all ids, each document (``first``: its first id, then the end) starting on a byte.

    Returns the bytes, each id's bit offset, and each document's first byte (and the end).
    """
    size = lengths[ids].astype(np.int64)
    total = np.append(0, np.cumsum(size))
    doc_bits = np.diff(total[first])
    doc_byte = np.append(0, np.cumsum(-(-doc_bits // 8)))
    shift = doc_byte[:-1] * 8 - total[first[:-1]]
    at = total[:-1] + np.repeat(shift, np.diff(first))
    word = codes[ids].astype(np.uint64) << (np.uint64(32) - size.astype(np.uint64) - (at & 7).astype(np.uint64))
    out = np.zeros(int(doc_byte[-1]) + 4, np.uint8)
    byte = at >> 3
    for k in range(4):  # bits of different ids never overlap, so adding is or-ing
        part = ((word >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64)
        out[:] |= np.bincount(byte + k, part, len(out)).astype(np.uint8)
    return out[:int(doc_byte[-1])].tobytes(), at, doc_byte


def build_segment(before: int, doc_ids: np.ndarray, null_id: np.ndarray, counts: np.ndarray, block_bits: np.ndarray,
                  payload_bytes: np.ndarray, payload: bytes, max_bits: int, block: int) -> bytes:
    """One binary segment; ``block_bits`` are bit lengths of the blocks, stored as offsets."""
    blocks = -(-counts // block)
    doc_byte = np.append(0, np.cumsum(payload_bytes))[:-1]
    first = np.append(0, np.cumsum(blocks))
    run = np.append(0, np.cumsum(block_bits))
    offset = run[:-1] - np.repeat(run[first[:-1]], blocks) + np.repeat(doc_byte * 8, blocks)
    head = _HEAD.pack(MAGIC, max_bits, block, before, len(doc_ids), len(block_bits))
    body = b"".join([doc_ids.astype("<i8").tobytes(), null_id.astype(np.uint8).tobytes(),
                     counts.astype("<u8").tobytes(), offset.astype("<u8").tobytes(), payload])
    return head + struct.pack("<I", zlib.crc32(body)) + body


def read_segment(data: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``ids before, doc_ids, null marks, counts, ids`` of a segment, all blocks decoded side by side."""
    magic, max_bits, block, before, n_docs, n_blocks = _HEAD.unpack_from(data)
    at = _HEAD.size
    (crc,) = struct.unpack_from("<I", data, at)
    body = memoryview(data)[at + 4:]
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("damaged segment")
    doc_ids = np.frombuffer(body, "<i8", n_docs)
    at = 8 * n_docs
    nulls = np.frombuffer(body, np.uint8, n_docs, at).astype(bool)
    at += n_docs
    counts = np.frombuffer(body, "<u8", n_docs, at).astype(np.int64)
    at += 8 * n_docs
    cursor = np.frombuffer(body, "<u8", n_blocks, at).astype(np.int64)
    at += 8 * n_blocks
    bits = np.append(np.frombuffer(body, np.uint8, -1, at), np.zeros(4, np.uint8)).astype(np.uint32)
    # 32 bits from every byte on, so that one lookup serves any bit offset
    window = (bits[:-3] << 24) | (bits[1:-2] << 16) | (bits[2:-1] << 8) | bits[3:]
    blocks = -(-counts // block)
    first = np.append(0, np.cumsum(blocks))
    size = np.full(n_blocks, block, np.int64)
    some = blocks > 0
    size[first[1:][some] - 1] = counts[some] - (blocks[some] - 1) * block
    out = np.empty(int(counts.sum()), np.uint32)
    place = np.append(0, np.cumsum(size))[:-1]
    order = np.argsort(-size, kind="stable")
    cursor, place, size = cursor[order], place[order], size[order]
    table_ids, table_bits = table
    mask, drop = np.uint32((1 << max_bits) - 1), np.uint32(32 - max_bits)
    live = n_blocks
    for step in range(int(size[0]) if n_blocks else 0):
        live = int(np.searchsorted(-size[:live], -step, "left"))  # blocks with more than ``step`` ids
        c = cursor[:live]
        # max_bits + 7 <= 32: a window of 32 bits from the byte holds the code
        key = (window[c >> 3] >> (drop - (c & 7).astype(np.uint32))) & mask
        out[place[:live] + step] = table_ids[key]
        cursor[:live] = c + table_bits[key]
    return before, doc_ids, nulls, counts, out


# --- Spark jobs ------------------------------------------------------------------

def _tokenize(path: str, drops_space: bool, end_id: int | None, width: str):
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(path, drops_space)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [np.frombuffer(b + tail, "<u4") for b in enc.ids(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([x.astype(width).tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "n_tokens", "ids"])
    return run


def token_table(docs: DataFrame, tokenizer_path: str, drops_space: bool, end_id: int | None, wide: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian binary, 16-bit unless ``wide``)."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_tokenize(tokenizer_path, drops_space, end_id, "<u4" if wide else "<u2"),
                          "doc_id long, n_tokens long, ids binary")


def _count(width: str, size: int):
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids = np.frombuffer(b"".join(batch.column(0).slice(lo, 256).to_pylist()), width)
                total += np.bincount(ids, minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])
    return run


def _ranges(doc_ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """The range of each doc_id: how many of the ascending ``bounds`` are below it; NULL is in the first."""
    part = np.searchsorted(bounds, doc_ids.fill_null(0).to_numpy(zero_copy_only=False), "left")
    part[doc_ids.is_null().to_numpy(zero_copy_only=False)] = 0
    return part.astype(np.int32)


def _sum_ranges(bounds):
    def run(batches):
        """Rows of ``doc_id, n_tokens`` to ids by range, one row for each range of a task."""
        total, seen = np.zeros(len(bounds.value) + 1, np.int64), np.zeros(len(bounds.value) + 1, bool)
        for batch in batches:
            part = _ranges(batch.column(0), bounds.value)
            np.add.at(total, part, batch.column(1).to_numpy())
            seen[part] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["part", "n"])
    return run


def _encode(width: str, codes, lengths, block: int, bounds):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts = np.asarray(part.column("n_tokens"))
                ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), width)
                first = np.append(0, np.cumsum(counts))
                data, at, byte = pack_bits(ids, first, codes.value, lengths.value)
                size = np.append(0, np.cumsum(lengths.value[ids].astype(np.int64)))
                docs, blocks = [], []
                for d in range(part.num_rows):
                    cuts = np.append(np.arange(first[d], first[d + 1], block), first[d + 1])
                    blocks.append(np.diff(size[cuts]).astype("<u2").tobytes())
                    docs.append(data[byte[d]:byte[d + 1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_ranges(part.column("doc_id"), bounds.value)), part.column("doc_id"), part.column("n_tokens"),
                     pa.array(blocks, pa.binary()), pa.array(docs, pa.binary())],
                    names=["part", "doc_id", "n_tokens", "blocks", "bits"])
    return run


def _segments(starts: dict[int, int], max_bits: int, block: int, segment_ids: int):
    def run(batches):
        current, before, held, n = None, 0, [], 0

        def flush():
            nonlocal before, held, n
            ids = np.array([0 if r[0] is None else r[0] for r in held], np.int64)
            null = np.array([r[0] is None for r in held])
            counts = np.array([r[1] for r in held], np.int64)
            blob = build_segment(before, ids, null, counts,
                                 np.frombuffer(b"".join(r[2] for r in held), "<u2").astype(np.int64),
                                 np.array([len(r[3]) for r in held], np.int64), b"".join(r[3] for r in held),
                                 max_bits, block)
            batch = pa.RecordBatch.from_arrays([pa.array([before], pa.int64()), pa.array([blob], pa.binary())],
                                               names=["first_token", "segment"])
            before, held, n = before + n, [], 0
            return batch

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "blocks", "bits")]
            for part, doc_id, count, blocks, bits in zip(*cols):
                if part != current:
                    if held:
                        yield flush()
                    current, before = part, starts[part]
                held.append((doc_id, count, blocks, bits))
                n += count
                if n >= segment_ids:
                    yield flush()
        if held:
            yield flush()
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, drops_space: bool = False, end_id: int | None = 0,
                 max_bits: int = MAX_BITS, block: int = BLOCK, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode all texts and write ``path/codes`` and ``path/segments`` in ascending doc_id order.

    A NULL text counts as empty; a NULL doc_id comes first; documents with
    equal ids follow each other in an order of their contents.
    """
    import json
    spark = docs.sparkSession
    size = _vocabulary_size(tokenizer_path)
    wide = size > 1 << 16
    width = "<u4" if wide else "<u2"
    tokens = written(token_table(docs, tokenizer_path, drops_space, end_id, wide), "huffman-ids")
    rows = tokens.select("ids").mapInArrow(_count(width, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, max_bits)
    codes_df = spark.createDataFrame([(json.dumps({"max_bits": max_bits, "block": block}), lengths.tobytes())], "settings string, lengths binary")
    codes_df.coalesce(1).write.parquet(f"{path}/codes")
    code_b, length_b = spark.sparkContext.broadcast(canonical_codes(lengths)), spark.sparkContext.broadcast(lengths)

    n = tokens.count()
    ranges = int(min(MAX_RANGES, max(1, -(-n // RANGE_ROWS))))
    cuts = tokens.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * MAX_RANGES)).first()[0] if ranges > 1 else []
    cuts = sorted(set(cuts or []))
    bounds = spark.sparkContext.broadcast(np.array(cuts, np.int64))
    totals = {r["part"]: r["n"] for r in tokens.select("doc_id", "n_tokens").mapInArrow(_sum_ranges(bounds), "part int, n long")
              .groupBy("part").agg(F.sum("n").alias("n")).collect()}
    starts, run = {}, 0
    for p in sorted(totals):
        starts[p] = run
        run += totals[p]
    bits = tokens.mapInArrow(_encode(width, code_b, length_b, block, bounds),
                             "part int, doc_id long, n_tokens long, blocks binary, bits binary")
    (bits.repartition(max(1, len(totals)), "part").sortWithinPartitions("part", "doc_id", "n_tokens", "bits")
     .mapInArrow(_segments(starts, max_bits, block, segment_ids), "first_token long, segment binary")
     .write.option("compression", "none").parquet(f"{path}/segments"))


def _vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def _read(lengths, max_bits: int, with_ids: bool):
    def run(batches):
        table = decode_table(lengths.value, max_bits)
        for batch in batches:
            for segment in batch.column(0):
                before, doc_ids, nulls, counts, ids = read_segment(segment.as_py(), table)
                first = np.append(0, np.cumsum(counts))
                raw = ids.astype("<u4").tobytes()
                parts = [raw[4 * a:4 * b] for a, b in zip(first[:-1], first[1:])]
                cols = [pa.array(doc_ids, mask=nulls), pa.array(before + first[:-1]), pa.array(counts),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode every segment: ``doc_id, start, n_tokens, ids_crc32`` and, if asked, ``ids`` (uint32)."""
    import json
    row = spark.read.parquet(f"{path}/codes").first()
    settings = json.loads(row["settings"])
    lengths = spark.sparkContext.broadcast(np.frombuffer(row["lengths"], np.uint8))
    segments = spark.read.schema("first_token long, segment binary").parquet(f"{path}/segments").select("segment")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return segments.mapInArrow(_read(lengths, settings["max_bits"], with_ids), schema)


def round_trip(docs: DataFrame, tokenizer_path: str, drops_space: bool = False, end_id: int | None = 0) -> DataFrame:
    """Write all documents under the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "huffman-tokens")
    write_tokens(docs, path, tokenizer_path, drops_space, end_id)
    return read_tokens(spark, path)
