"""Splittable scans of quoted CSV and line text, with ids that do not depend on the splits.

A quoted field may hold newlines, so a CSV file cannot be cut at just any
newline.  But a newline ends a record exactly where the number of quotes
before it in the file is even (a doubled quote counts twice).  So:

1. one scan over the lines (Spark splits text files by bytes) counts, for
   every split, its lines, its quotes and the lines at an even place;
2. prefix sums over a file's splits tell for each split whether it begins
   inside a record and how many records begin before it;
3. a second scan joins lines to records inside each split.  A record that a
   split's end cuts is put together from its parts by a small shuffle, at most
   two parts per split (only where some record is cut are the lines read once
   more for it); ``from_csv`` then parses the records.

The table of splits comes to the driver: one short row per scan split, fewer
than the tasks the driver plans for the same scan.

Ids are ``file * 2**40 + number``: the place of the file among the scanned
files' sorted names and the number of the record (or line) in its file.  They
stay the same under every ``maxPartitionBytes``, cluster and order of the scan,
as long as the set of files does.

Limits: quotes stand only around fields and doubled inside them (RFC 4180).  A
file that opens a quote and never closes it is one record to its end.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records or lines of one file that ids have room for.
FILE_IDS = 1 << 40
#: Bytes of small splits that one task reads, where that leaves so many tasks for every core.
TASK_BYTES, TASKS_PER_CORE = 16 << 20, 16


def scanned_lines(spark: SparkSession, paths) -> DataFrame:
    """``line, file, block`` of text files: every line with the split it comes from.

    Splits far smaller than ``TASK_BYTES`` are read several to a task, so the
    number of tasks follows the bytes and not the size of a split.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"))
    splits, most = lines.rdd.getNumPartitions(), _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    tasks = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, math.ceil(splits * most / TASK_BYTES))
    return lines.coalesce(tasks) if tasks < splits else lines


def _bytes(setting: str) -> int:
    """Bytes of a size setting such as ``64k``, ``128MB`` or ``134217728b``."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """The batch's runs of lines of one split."""
    if not batch.num_rows:
        return
    files = batch.column("file").dictionary_encode()
    index, block = files.indices.to_numpy(), batch.column("block").to_numpy()
    cuts = np.flatnonzero((index[1:] != index[:-1]) | (block[1:] != block[:-1])) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield files.dictionary[int(index[lo])].as_py(), int(block[lo]), batch.column("line").slice(lo, hi - lo)


def _quotes(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)


def _split_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map: one row per split and batch, in the order of the split's lines."""
    seen: dict[tuple[str, int], list] = {}
    for batch in batches:
        for file, block, lines in _segments(batch):
            quotes = _quotes(lines)
            entry = seen.setdefault((file, block), [0, 0, 0, lines[0].as_py().endswith("\r")])
            before = entry[1] + np.cumsum(quotes) - quotes
            entry[0] += len(lines)
            entry[1] += int(quotes.sum())
            entry[2] += int(np.count_nonzero(before % 2 == 0))
    rows = [(f, b, *v) for (f, b), v in seen.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
        (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["file", "block", "lines", "quotes", "even", "crlf"])


def split_table(lines: DataFrame) -> dict[tuple[str, int], tuple[int, int, int, int, bool]]:
    """(file, block) -> id of the first line, id of the first record, quotes before it (0 or 1), quotes in it (0 or 1), CR LF file."""
    rows = lines.mapInArrow(_split_counts, "file string, block long, lines long, quotes long, even long, crlf boolean").collect()
    files = {name: i for i, name in enumerate(sorted({r["file"] for r in rows}))}
    out, last = {}, None
    for r in sorted(rows, key=lambda r: (r["file"], r["block"])):
        if r["file"] != last:
            last, line, record, odd, crlf = r["file"], 0, 0, 0, r["crlf"]
        base = files[last] * FILE_IDS
        out[(last, r["block"])] = (base + line, base + record, odd, r["quotes"] % 2, crlf)
        line += r["lines"]
        record += r["lines"] - r["even"] if odd else r["even"]
        odd = (odd + r["quotes"]) % 2
    return out


def _joined_records(splits, whole: bool):
    """Map: lines -> records inside one split (``whole``) or the parts of cut ones: id, block, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = splits.value
        now = None

        def closed(parts: list, cut: bool):
            """The record held so far; cut: it begins or ends in another split."""
            if not parts or cut == whole:
                return []
            return [(record - 1, now[1], "\n".join(x for p in parts for x in p.to_pylist()))]

        record, odd, held, cut, done = 0, 0, [], False, []
        for batch in batches:
            for file, block, lines in _segments(batch):
                if (file, block) != now:
                    done += closed(held, cut or odd == 1)
                    now = (file, block)
                    _, record, odd, _, crlf = table[now]
                    held, cut = [], odd == 1
                if crlf:
                    lines = pc.replace_substring_regex(lines, "\r$", "")
                quotes = _quotes(lines)
                first = np.flatnonzero((odd + np.cumsum(quotes) - quotes) % 2 == 0)
                odd = (odd + int(quotes.sum())) % 2
                if not len(first):
                    held.append(lines)
                    continue
                if first[0]:
                    held.append(lines.slice(0, int(first[0])))
                done += closed(held, cut)
                if whole and len(first) > 1:  # records between the first and the last beginning are complete
                    inner = lines.slice(int(first[0]), int(first[-1] - first[0]))
                    text = pc.binary_join(pa.ListArray.from_arrays(pa.array((first - first[0]).astype(np.int32)), inner), "\n")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(record + np.arange(len(text))), pa.array(np.full(len(text), block)), text], names=["id", "block", "text"])
                record += len(first)
                held, cut = [lines.slice(int(first[-1]))], False
            if done:
                yield _part_rows(done)
                done = []
        done += closed(held, cut or odd == 1)
        if done:
            yield _part_rows(done)
    return run


def _part_rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))],
                                      names=["id", "block", "text"])


def read_records(spark: SparkSession, path) -> DataFrame:
    """``id, record``: every record of quoted CSV files, as text, with its stable id.  A file's first record has number 0."""
    lines = scanned_lines(spark, path)
    table = split_table(lines)
    splits = spark.sparkContext.broadcast(table)
    schema = "id long, block long, text string"
    records = lines.mapInArrow(_joined_records(splits, True), schema).select("id", F.col("text").alias("record"))
    if not any(odd for _, _, odd, _, _ in table.values()):
        return records
    # the same scan again: a scan of fewer files would be split at other places
    parts = lines.mapInArrow(_joined_records(splits, False), schema)
    joined = parts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("p")) \
        .select("id", F.array_join("p.text", "\n").alias("record"))
    return records.unionByName(joined)


def _line_ids(splits):
    """Map: lines -> line, id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            for file, block, lines in _segments(batch):
                if (file, block) != now:
                    now, at = (file, block), splits.value[(file, block)][0]
                yield pa.RecordBatch.from_arrays([pa.array(at + np.arange(len(lines))), lines], names=["id", "line"])
                at += len(lines)
    return run


def read_numbered_lines(spark: SparkSession, path) -> DataFrame:
    """``id, line`` of text files: every line (without a CR at its end) with its stable id."""
    lines = scanned_lines(spark, path)
    splits = spark.sparkContext.broadcast(split_table(lines))
    return lines.mapInArrow(_line_ids(splits), "id long, line string").withColumn("line", F.regexp_replace("line", "\r$", ""))
