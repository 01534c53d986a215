"""Near duplicates, decontamination, repeated strings and token files against plain-Python versions."""

import hashlib
import os
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from revlens.llm import huffman, packing, queries  # noqa: E402
from revlens.llm.decontaminate import decontaminate  # noqa: E402
from revlens.llm.minhash import near_duplicates  # noqa: E402
from revlens.llm.shuffle_tools import join_salted  # noqa: E402
from revlens.llm.suffix_dedup import remove_repeats  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(9000))


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    """Sampled documents and the cases that need a defined result."""
    taken = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(150).collect()]
    base = taken[5][1]
    words = base.split(" ")
    extra = [(1000, None), (1001, ""), (1002, "   \n"), (1003, "one two"), (1004, "one two"), (1005, "Émile ÀÉ KK x"),
             (1006, base), (1007, " ".join(words[:-3] + ["changed"] + words[-2:])), (1008, LONG), (1009, LONG + " tail"),
             (1010, "a" * 3000), (1011, "xy" * 900), (1006, base), (None, base), (None, None), (1012, "<|endoftext|> a<|endoftext|>b  c"),
             (1013, base.upper()), (1014, "x" + base[:900] + "y" + base[100:1000])]
    return taken + extra


@pytest.fixture(scope="module")
def odd_df(spark, odd):
    df = spark.createDataFrame(odd, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("node", "uid", "n", "start", "bucket", "w", "rep")]).repartition(5).cache()


EMPTY = "doc_id long, text string"


def test_near_duplicates(spark, odd, odd_df):
    assert rows(near_duplicates(odd_df, shingle_words=4)) == brute.near_duplicates(odd)
    assert near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


def test_near_duplicate_chains(spark):
    """Links that only hold between neighbours, and a group of near copies of one text."""
    w = [f"t{i}" for i in range(260)]
    chain = [(i, " ".join(w[i * 8:i * 8 + 100])) for i in range(20)]
    group = [(100 + i, " ".join(f"g{j}" if j != i else "edit" for j in range(120))) for i in range(60)]
    docs = chain + group
    assert rows(near_duplicates(spark.createDataFrame(docs, EMPTY), shingle_words=4)) == brute.near_duplicates(docs)


def test_decontaminate(spark, odd, odd_df):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    text = odd[20][1]
    items += [(900, None), (901, ""), (902, "one two"), (903, " ".join(text.split()[3:40])), (904, "K"), (905, text), (905, text), (None, text)]
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("win", F.lit(2)).withColumn("size", F.lit(3))
    assert rows(decontaminate(odd_df, df)) == brute.decontaminate(odd, items)
    assert rows(decontaminate(odd_df, df.limit(0))) == brute.decontaminate(odd, [])
    assert decontaminate(odd_df.limit(0), df).count() == 0


def test_decontaminate_with_hot_words(spark):
    """A word that is an item of its own, under many ids, holds most places of the join."""
    docs = [(i, " ".join(["the"] * 40 + [f"w{i % 7}", "the", "rare" if i % 50 == 0 else "usual"])) for i in range(400)]
    items = [(k, "the") for k in range(30)] + [(40, "the the"), (41, "rare"), (42, "w3 the usual"), (43, "absent")]
    found = decontaminate(spark.createDataFrame(docs, EMPTY), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(found) == brute.decontaminate(docs, items)


def test_salted_join(spark):
    big = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(3000)], "k int, pos int").cache()
    weights = big.groupBy("k").agg(F.count("*").alias("w"))
    dim = weights.where("k <> 3").withColumn("v", F.explode(F.array(F.lit("a"), F.lit("b"))))
    for share in (1 / 1000, 1 / 20):
        got = rows(join_salted(big, dim, ["k"], "w", ["pos"], share), "k", "pos", "v")
        assert got == rows(big.join(dim, "k"), "k", "pos", "v")
    assert join_salted(big, dim.limit(0), ["k"], "w", ["pos"]).count() == 0


@pytest.mark.parametrize("span,gram", [(400, 100), (60, 15)])
def test_remove_repeats(spark, odd, odd_df, span, gram):
    got = remove_repeats(odd_df, span, gram).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("s"))
    assert rows(got) == brute.remove_repeats(odd, span)
    assert remove_repeats(odd_df.limit(0)).count() == 0


def _ids(name, texts, end):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(queries.tokenizer_file(name))
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_huffman_round_trip(spark, odd, odd_df):
    unique = [(d, t) for d, t in odd if d is not None and (d, t) != (1006, odd[5][1])]
    unique.append((-3, "first\r\n  of all here, don't"))
    got = rows(huffman.round_trip(spark.createDataFrame(unique, EMPTY).repartition(3), queries.tokenizer_file("byte_bpe_50k.json")))
    want, start = [], 0
    unique.sort(key=lambda x: x[0])
    for (d, _), ids in zip(unique, _ids("byte_bpe_50k.json", [t for _, t in unique], 0)):
        want.append((d, start, len(ids), _crc(ids)))
        start += len(ids)
    assert got == sorted(want, key=str)
    assert huffman.round_trip(odd_df.limit(0), queries.tokenizer_file("byte_bpe_50k.json")).count() == 0
    all_rows = huffman.round_trip(odd_df, queries.tokenizer_file("byte_bpe_50k.json")).collect()
    assert sorted((str(r.doc_id), r.ids_crc32) for r in all_rows) == sorted(
        (str(d), _crc(i)) for (d, _), i in zip(odd, _ids("byte_bpe_50k.json", [t for _, t in odd], 0)))
    ends = sorted((r.start, r.start + r.n_tokens) for r in all_rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_huffman_ranges(spark, odd, monkeypatch):
    """Several ranges and segments: ascending doc_id order across all of them."""
    monkeypatch.setattr(huffman, "RANGE_ROWS", 20)
    docs = [(i * 3, t) for i, (_, t) in enumerate(odd)]
    path = queries.tokenizer_file("byte_bpe_50k.json")
    from revlens.session import scratch_path
    out = scratch_path(spark, "huffman-test")
    huffman.write_tokens(spark.createDataFrame(docs, EMPTY).repartition(4), out, path, segment_ids=2000)
    got = huffman.read_tokens(spark, out, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [d for d, _ in docs]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == _ids("byte_bpe_50k.json", [t for _, t in docs], 0)
    assert spark.read.parquet(out + "/segments").count() > 5


def test_huffman_many_ranges(spark, monkeypatch):
    """Over 64 ranges: ids beyond 2 to the 53rd, a NULL id and ids below zero come in order."""
    monkeypatch.setattr(huffman, "RANGE_ROWS", 2)
    ids = [None, -2 ** 62, -5, *range(7, 400, 3), *(2 ** 60 + k for k in range(40))]
    docs = [(d, f"text number {i}, again") for i, d in enumerate(ids)]
    path = queries.tokenizer_file("byte_bpe_50k.json")
    got = huffman.round_trip(spark.createDataFrame(docs[::-1], EMPTY).repartition(4), path).orderBy("start").collect()
    assert [r.doc_id for r in got] == ids
    want = _ids("byte_bpe_50k.json", [t for _, t in docs], 0)
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got] == [
        (sum(map(len, want[:i])), len(x), _crc(x)) for i, x in enumerate(want)]


def test_code_lengths():
    rng = np.random.default_rng(3)
    for limit in (5, 8, 18):
        counts = np.where(rng.random(30) < 0.2, 0, (rng.random(30) ** 9 * 1e6).astype(int) + 1)
        lengths = huffman.code_lengths(counts, limit)
        used = lengths[counts > 0].astype(float)
        assert (lengths[counts == 0] == 0).all() and used.max() <= limit and (0.5 ** used).sum() == 1
        codes = huffman.canonical_codes(lengths)
        words = [format(codes[i], f"0{lengths[i]}b") for i in np.flatnonzero(counts)]
        assert not any(a != b and b.startswith(a) for a in words for b in words)
    # unlimited: as good as Huffman's algorithm
    import heapq
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    assert int((counts * huffman.code_lengths(counts, 30)).sum()) == cost


def test_packing(spark, odd, odd_df):
    path = queries.tokenizer_file("word_bpe_49k.json")
    got = packing.pack_documents(odd_df, path, capacity=512, with_ids=True).collect()
    whole = {}
    for r in sorted(got, key=lambda r: (str(r.doc_id), r.start)):
        assert 0 < r.length <= 512 and _crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == 4 * r.length
        assert r.start == 512 * r.piece
    unique = [(d, t) for d, t in odd if d is not None and d != 1006]
    for r in sorted(got, key=lambda r: r.start):
        whole.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert [whole[d] for d, _ in unique] == _ids("word_bpe_49k.json", [t for _, t in unique], 1)
    fills = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert fills.get(r.sequence_id, 0) == r.offset
        fills[r.sequence_id] = r.offset + r.length
    total = sum(r.length for r in got)
    assert max(fills.values()) <= 512 and len(fills) <= -(-total // 512) + 2
    assert len(got) == sum(-(-len(i) // 512) for i in _ids("word_bpe_49k.json", [t for _, t in odd], 1))
    assert packing.pack_documents(odd_df.limit(0), path).count() == 0


def test_local_search_saves_bins():
    saved = 0
    for seed in range(6):
        lengths = np.random.default_rng(seed).integers(1000, 3000, 3000)
        first = packing.best_fit(lengths, 4096)
        last = packing.improve(lengths, first, 4096, 10**6)
        fill = np.bincount(last, lengths)
        saved += len(set(first.tolist())) - int((fill > 0).sum())
        assert fill.max() <= 4096 and (fill ** 2.0).sum() > (np.bincount(first, lengths) ** 2.0).sum()
    assert saved > 0


def test_local_search_uses_pairs():
    """Neither a move nor a one-for-one exchange helps, an exchange of two does."""
    lengths = np.array([7, 6, 5, 3, 3, 6])
    bins = np.array([0, 0, 1, 1, 1, 2])
    out = packing.improve(lengths, bins, 14, 100)
    assert np.bincount(out, lengths).max() <= 14 and (np.bincount(out, lengths) ** 2.0).sum() >= (np.bincount(bins, lengths) ** 2.0).sum()


def test_wordwise_encoding_equals_whole(odd):
    from revlens.llm.tokens import Encoder
    texts = [t for _, t in odd] + ["a.b,c  d\t\ne's I'M don't 12,3 x..y é.É ß,  .　z  ", " lead", "trail  ", "á .b"]
    for name, drops, end in (("byte_bpe_50k.json", False, 7), ("word_bpe_49k.json", True, 7)):
        enc = Encoder(queries.tokenizer_file(name), drops, cache_pieces=500)
        got = [np.frombuffer(b, "<u4").tolist() + [7] for b in enc.ids(texts)]
        assert got == _ids(name, texts, end)


def test_letters_are_encoded_without_the_batch(monkeypatch):
    """Pieces of letters go to the model alone, all others to the library's batches; the ids are the library's."""
    from revlens.llm.tokens import Encoder
    texts = ["Plain words and été Ωmega Łódź ǅ ªº 漢字 x1 a_b don't", "\nnew  line, end.", "été", " Words", "<|endoftext|> raw"]
    enc = Encoder(queries.tokenizer_file("byte_bpe_50k.json"), False)
    batched, batch = [], enc._encode_batch
    monkeypatch.setattr(enc, "_encode_batch", lambda pieces: batched.extend(pieces) or batch(pieces))
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.ids(texts)] == [x[:-1] for x in _ids("byte_bpe_50k.json", texts, 0)]
    assert batched and not {"Plain", " words", " été", " Łódź"} & set(batched)
    assert not Encoder(queries.tokenizer_file("word_bpe_49k.json"), True).letters


def test_lower_case_words_are_encoded_without_the_batch(monkeypatch):
    """The same for a tokenizer that drops space and case: a word of letters is one word after its normalizer."""
    from revlens.llm.tokens import Encoder
    texts = ["Plain words, and \u00e9t\u00e9. J\u030c \u0130x \u0130. \u0130, \u00d8re na\u00efve don't x1", "nothing   odd", "", "<|startoftext|>", "\u3000wide\u00a0space\u2028end"]
    for some in (texts, texts[3:4], texts[2:3], []):
        enc = Encoder(queries.tokenizer_file("word_bpe_49k.json"), True)
        batched, batch = [], enc._encode_batch
        monkeypatch.setattr(enc, "_encode_batch", lambda pieces: batched.extend(pieces) or batch(pieces))
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.ids(some)] == [x[:-1] for x in _ids("word_bpe_49k.json", some, 0)]
        assert not {"words", "plain", "na\u00efve", "nothing"} & set(batched)


def test_words_in_use_stay_when_the_table_is_full(monkeypatch):
    """Rare pieces fill the table many times over; a word of every text is encoded once."""
    from revlens.llm.tokens import Encoder
    enc = Encoder(queries.tokenizer_file("byte_bpe_50k.json"), False, cache_pieces=100)
    encoded, encode = [], enc._encode
    monkeypatch.setattr(enc, "_encode", lambda pieces: encoded.extend(pieces) or encode(pieces))
    for n in range(30):
        texts = ["".join(f" rare{'abcdefghij'[n % 10]}{'klmno'[n // 10]}{c}" for c in "abcdefghijklmnopqrst") + " often"]
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.ids(texts)] == [x[:-1] for x in _ids("byte_bpe_50k.json", texts, 0)]
        assert len(enc.cache) + len(enc.older) <= 100
    assert encoded.count(" often") == 1 and len(encoded) > 300
