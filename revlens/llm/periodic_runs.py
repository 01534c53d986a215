"""Runs of periodically repeated words, by an online sparse diagonal recurrence.

A run of period q is a diagonal of matches: word i equals word i - q, over and
over.  Reading a text word by word, each word's earlier occurrences carry the
match lengths of their lags on: ``length[lag] = length[lag] + 1``; a lag
without a match ends, and its run is emitted at once if it is long enough.

Only diagonals that can still become a run are looked at.  A run has at least
four periods, so on its diagonal at least 3 q words match.  Lags are therefore
opened by class j, ``2**j <= q < 2**(j + 1)``, once the last ``3 * 2**j`` words
have occurred before, and only the nearest such occurrence counts: were a
nearer one at lag d < q, those words would have the periods d and q, hence
gcd(d, q) (Fine and Wilf), and q would not be the run's smallest period.  A
word thus has at most log2(n) active lags, a text costs O(n log n) also when
it repeats one word only, and every lag met is a smallest period.

Words are compared by 64-bit hashes of windows inside one document.  One
document is handled by one task; it needs about 100 bytes per word.

Defined results: NULL, empty and wordless texts have no words, no runs and an
empty collapsed text; repeated rows give repeated rows; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.text_kernel import NON_SPACE, Words, gathered, mix64, row_slices, text_bytes, words_of

#: Shortest run in words and in periods (class windows of 3 * 2**j words rely on at least 4 periods).
SHORTEST, PERIODS = 6, 4

_U = np.uint64
_PAIR = _U(0xA0761D6478BD642F)
_FIRST = _U(0xE7037ED1A0B428DB)


def lags(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (word, lag, window) at which a lag of a class is matched by the window of words that ends at the word.

    Sorted by word.  Windows of a class are pairs of the windows of the class
    below; only places whose shorter window occurred before are looked at again.
    """
    counts = words.counts
    row = np.repeat(np.arange(len(counts)), counts)
    left = words.first[1:][row] - np.arange(len(row))  # words up to the row's end
    h = words.hash ^ mix64((row + 1).astype(_U) * _FIRST)
    at = np.flatnonzero(left >= 3)
    full = np.zeros(len(h), _U)
    full[at] = mix64(mix64(h[at] * _PAIR + h[at + 1]) * _PAIR + h[at + 2])
    out, size, step = [], 3, 1
    while len(at):
        value = full[at]
        order = np.argsort(value, kind="stable")
        same = value[order][1:] == value[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        lag = np.zeros(len(at), np.int64)
        lag[order[1:][same]] = at[order[1:][same]] - at[order[:-1][same]]
        fits = again & (lag >= step) & (lag < 2 * step)
        out.append((at[fits] + size - 1, lag[fits], np.full(int(fits.sum()), size)))
        # a longer window that occurred before begins and continues with windows that occur more than once
        often = again.copy()
        often[order[:-1][same]] = True
        repeated = np.zeros(len(h) + 1, bool)
        repeated[at[often]] = True
        at = at[often]
        at = at[left[at] >= 2 * size]
        at = at[repeated[at + size]]
        nxt = np.zeros(len(h), _U)
        nxt[at] = mix64(full[at] * _PAIR + full[at + size])
        full, size, step = nxt, 2 * size, 2 * step
    word, lag, window = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    order = np.argsort(word, kind="stable")
    return word[order], lag[order], window[order]


def runs_of(words: Words) -> list[list[tuple[int, int, int]]]:
    """Runs of each row as (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words.counts]
    row_of = np.searchsorted(words.first, np.arange(len(words.hash)), "right") - 1
    active: dict[int, tuple[int, int]] = {}  # lag -> last word, length of the match

    def emit(lag: int, last: int, length: int) -> None:
        if length + lag >= max(SHORTEST, PERIODS * lag):
            row = int(row_of[last])
            out[row].append((last - length - lag + 1 - int(words.first[row]), length + lag, lag))

    at = -1
    word, lag, window = (x.tolist() for x in lags(words))
    for i, q, size in zip(word, lag, window):
        if i != at:
            for lost in [x for x, (last, _) in active.items() if last < i - 1]:
                emit(lost, *active.pop(lost))
            at = i
        active[q] = (i, active[q][1] + 1 if q in active else size)
    for q, (last, length) in active.items():
        emit(q, last, length)
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def _collapsed(words: Words, found: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of the texts without the words a run repeats, joined by one space."""
    change = np.zeros(len(words.hash) + 1, np.int64)
    for row, runs in enumerate(found):
        base = int(words.first[row])
        for start, length, period in runs:
            change[base + start + period] += 1
            change[base + start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    row_first = np.searchsorted(kept, words.first)
    begin, end = words.start[kept], words.end[kept]
    # every word but the last of its row takes a space along: word bytes first, then the space behind it
    width = end - begin + 1
    ends = row_first[1:][np.diff(row_first) > 0] - 1
    width[ends] -= 1
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(width)])
    data = np.full(int(offsets[-1]), 32, np.uint8)
    text, at = gathered(words.buf, begin, end)
    data[np.arange(len(text)) + np.repeat(offsets[:-1] - at[:-1], end - begin)] = text
    return data, offsets[row_first]


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        buf, offsets = text_bytes(batch.column("text"))
        for lo, hi in row_slices(offsets):
            words = words_of(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1], NON_SPACE, fold=False)
            found = runs_of(words)
            data, at = _collapsed(words, found)
            flat = np.array([r for x in found for r in x], np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(run))
            sizes = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array(words.counts.astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(sizes), structs),
                 pa.Array.from_buffers(pa.string(), hi - lo, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])],
                names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, n_words, runs (start, length, period), collapsed text.

    ``collapsed`` keeps of every run its first period, words joined by one space.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _run_rows, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def run_report(docs: DataFrame) -> DataFrame:
    """The runs of ``periodic_runs`` as numbers and digests per document."""
    def longest(a, b):
        more = (b["length"] > a["length"]) | ((b["length"] == a["length"]) & (
            (b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"]))))
        return F.when(a.isNull() | more, b).otherwise(a)

    found = periodic_runs(docs)
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                   r["period"].cast("string"), F.lit("\n")))
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.aggregate("runs", none, longest).alias("best"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``docs`` in which one document in ten (by the crc32 of its id) ends in a repeated stretch of words.

    h = crc32(decimal doc_id), g = floor(h / 10).  Where h % 10 = 0 and there
    are n > 0 words, word i >= a becomes word a + (i - a) % p with a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)).  A NULL doc_id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    altered = F.expr("""transform(_words, (w, i) -> CASE WHEN i < _a THEN w ELSE _words[_a + (i - _a) % _p] END)""")
    chosen = docs.select("doc_id", "text", h.alias("_h")) \
        .withColumn("_words", F.when(F.col("_h") % 10 == 0, F.expr(r"regexp_extract_all(text, '([^\\x20\\x09-\\x0D]+)', 1)"))) \
        .withColumn("_n", F.coalesce(F.size("_words"), F.lit(0))) \
        .withColumn("_g", F.expr("_h div 10")) \
        .withColumn("_a", F.expr("CASE WHEN _n > 0 THEN cast(_g % _n AS int) END")) \
        .withColumn("_p", F.expr("CASE WHEN _n > 0 THEN 1 + cast((_n - _a) div (3 + _g % 8) AS int) END"))
    return chosen.select("doc_id", F.when(F.col("_n") > 0, F.array_join(altered, " ")).otherwise(F.col("text")).alias("text"))
