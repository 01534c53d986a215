"""Packing tokenised documents into sequences: best fit and swap-based local search.

A document is its token ids and the end id; one longer than a sequence is cut
into full pieces and a rest.  Full pieces are sequences of their own.  The
others are packed in groups of bounded size, drawn by hash so that every group
has the same mix of lengths:

1. best fit by decreasing length;
2. local search between the underfull bins of the group: a document moves to
   another bin, is exchanged one for one, or against two, whenever the sum of
   squared fills rises.  The fuller bins fill up and the emptiest runs empty;
   it stops at the lower bound or when no exchange helps;
3. the bins still underfull in all groups are pooled and packed anew, in fewer
   groups, as long as that saves sequences.

The sum of squared fills only rises and is bounded, so the search ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.shuffle_tools import written
from revlens.llm.tokens import encoder

SEQUENCE = 4096
#: Pieces packed together in one task call.
GROUP_PIECES = 8192
#: A bin filled to this share stays as it is after a round.
GOOD_FILL = 0.998
#: Exchanges tried for one group, at most, per piece in it.
MOVES_PER_PIECE = 4
#: The search of a group ends when so many of its emptiest bins can give nothing away.
STUCK_BINS = 32


# --- one group -----------------------------------------------------------------

def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: decreasing length, into the fullest bin that has room."""
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0  # bit r of ``rooms``: a bin with r left exists
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, made
            made += 1
        bins[i] = b
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins


def _pair_sums(items: list[int], lengths: np.ndarray) -> list[tuple[int, int, int]]:
    return [(int(lengths[i] + lengths[j]), i, j) for k, i in enumerate(items) for j in items[k + 1:]]


def improve(lengths: np.ndarray, bins: np.ndarray, capacity: int, budget: int) -> np.ndarray:
    """Local search by moves and exchanges that raise the sum of squared fills.

    The emptiest bin gives: each step takes content out of it and puts it in a
    bin at least as full, which raises the sum.  When no step helps, that bin
    is set aside and the next emptiest gives.
    """
    bins = bins.copy()
    fill = np.bincount(bins, lengths).astype(np.int64)
    least = -(-int(lengths.sum()) // capacity)
    stuck: set[int] = set()
    while budget > 0 and len(stuck) < STUCK_BINS and int((fill > 0).sum()) > least:
        open_bins = np.flatnonzero((fill > 0) & (fill < capacity))
        open_bins = open_bins[[b not in stuck for b in open_bins.tolist()]] if stuck else open_bins
        if len(open_bins) < 2:
            break
        giver = int(open_bins[np.argmin(fill[open_bins])])
        step = _step(lengths, bins, fill, capacity, giver)
        if step is None:
            stuck.add(giver)
            continue
        out, back, taker = step
        delta = int(lengths[out].sum() - lengths[back].sum())
        bins[out], bins[back] = taker, giver
        fill[giver] -= delta
        fill[taker] += delta
        budget -= 1
    return bins


def _step(lengths, bins, fill, capacity, giver):
    """The first of move, one for one, one for two, two for one that raises the sum:
    ``(pieces out, pieces back, taking bin)``; of each kind the one that fills a bin best."""
    mine = np.flatnonzero(bins == giver)
    room = capacity - fill
    takers = np.flatnonzero((fill >= fill[giver]) & (room > 0))
    takers = takers[takers != giver]
    if not len(takers):
        return None
    for i in mine[np.argsort(-lengths[mine], kind="stable")]:  # move
        fits = takers[room[takers] >= lengths[i]]
        if len(fits):
            return np.array([i]), np.array([], np.int64), int(fits[np.argmin(room[fits])])
    open_mask = np.zeros(len(fill), bool)
    open_mask[takers] = True
    theirs = np.flatnonzero(open_mask[bins])
    free = room[bins[theirs]]
    best, choice = None, None
    for i in mine:  # one for one
        gain = lengths[i] - lengths[theirs]
        left = np.where((gain > 0) & (gain <= free), free - gain, capacity + 1)
        j = int(np.argmin(left))
        if left[j] <= capacity and (best is None or left[j] < best):
            best, choice = int(left[j]), (np.array([i]), theirs[j:j + 1], int(bins[theirs[j]]))
            if best == 0:
                break
    if choice is not None:
        return choice
    if len(mine) <= 64:  # two of mine for one of theirs
        for total, i, j in _pair_sums(mine.tolist(), lengths):
            gain = total - lengths[theirs]
            left = np.where((gain > 0) & (gain <= free), free - gain, capacity + 1)
            t = int(np.argmin(left))
            if left[t] <= capacity and (best is None or left[t] < best):
                best, choice = int(left[t]), (np.array([i, j]), theirs[t:t + 1], int(bins[theirs[t]]))
    if choice is not None:
        return choice
    for b in takers[np.argsort(room[takers])[:64]]:  # one of mine for two of theirs
        pairs = _pair_sums(np.flatnonzero(bins == b)[:64].tolist(), lengths)
        if not pairs:
            continue
        sums = np.array([p[0] for p in pairs])
        for i in mine:
            gain = lengths[i] - sums
            left = np.where((gain > 0) & (gain <= room[b]), room[b] - gain, capacity + 1)
            t = int(np.argmin(left))
            if left[t] <= capacity and (best is None or left[t] < best):
                best, choice = int(left[t]), (np.array([i]), np.array(pairs[t][1:]), int(b))
    return choice


def pack_group(lengths: np.ndarray, capacity: int = SEQUENCE) -> np.ndarray:
    """Bin of each piece of one group (best fit, then local search)."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    bins = best_fit(lengths, capacity)
    return improve(lengths, bins, capacity, MOVES_PER_PIECE * len(lengths))


# --- Spark jobs ------------------------------------------------------------------

def _pieces(path: str, drops_space: bool, end_id: int, capacity: int, with_ids: bool):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(path, drops_space)
        task = TaskContext.get().partitionId()
        made = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, piece, start, length, crc, data = [], [], [], [], [], []
                for r, raw in enumerate(enc.ids(part.column(1).to_pylist())):
                    raw += tail
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[at:at + 4 * capacity]
                        rows.append(r)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            data.append(cut)
                uid = (task << 36) + made + np.arange(len(rows))  # the same again if the task is run again
                made += len(rows)
                cols = [pa.array(uid, pa.int64()), part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(data, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def _pack(capacity: int, round_no: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("uid", "ascending")])
        lengths = table["length"].to_numpy().astype(np.int64)
        bins = pack_group(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        size = lengths[order]
        own = bins[order]
        run_up = np.cumsum(size) - size
        first = np.append(True, own[1:] != own[:-1])
        offset = run_up - np.repeat(run_up[first], np.diff(np.append(np.flatnonzero(first), len(own))))
        fill = np.bincount(bins, lengths).astype(np.int64)
        group = int(table["pack_group"][0].as_py())
        seq = (round_no << 56) + (group << 20) + own
        return pa.table({"uid": table["uid"].combine_chunks().take(pa.array(order)), "length": pa.array(size),
                         "sequence_id": pa.array(seq), "offset": pa.array(offset), "fill": pa.array(fill[own])})
    return run


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``uid, sequence_id, offset`` for pieces ``uid, length`` (unique uid, 1..capacity ids each)."""
    full = pieces.where(F.col("length") == capacity).select(
        "uid", F.col("uid").bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = written(pieces.where(F.col("length") < capacity).select("uid", "length"), "pack-rest")
    done, n, used = [full], rest.count(), None
    for round_no in range(1, 63):
        groups = max(1, -(-n // group_pieces))
        dealt = rest.withColumn("pack_group", F.pmod(F.xxhash64("uid", F.lit(round_no)), F.lit(groups)))
        packed = written(dealt.groupBy("pack_group").applyInArrow(
            _pack(capacity, round_no), "uid long, length long, sequence_id long, offset long, fill long"), "pack-round")
        poor = packed.where(F.col("fill") < F.lit(int(capacity * GOOD_FILL)))
        seen = poor.agg(F.count("*").alias("n"), F.count_distinct("sequence_id").alias("bins")).first()
        again = groups > 1 and seen["n"] > 0 and (used is None or seen["bins"] < used)
        cols = ["uid", "sequence_id", "offset"]
        if not again:
            done.append(packed.select(*cols))
            break
        done.append(packed.where(F.col("fill") >= F.lit(int(capacity * GOOD_FILL))).select(*cols))
        rest, n, used = poor.select("uid", "length"), seen["n"], seen["bins"]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, drops_space: bool = True, end_id: int = 1,
                   capacity: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if asked, ``ids`` (uint32) per piece.

    A NULL text is empty and leaves only the end id; rows that repeat a
    doc_id are packed one by one; a NULL doc_id is carried as it is.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    pieces = written(src.mapInArrow(_pieces(tokenizer_path, drops_space, end_id, capacity, with_ids), schema), "pack-pieces")
    places = pack_pieces(pieces.select("uid", "length"), capacity)
    return pieces.join(places, "uid").select(*[c for c in pieces.columns if c != "uid"], "sequence_id", "offset")
