"""Whole-text encoding with a public tokenizer, one table lookup per word.

Both tokenizers used here split a text into words before anything else, and
their splitting never looks back, so a text may be cut before white space and
between a letter or digit and a comma or dot: encoding the pieces one by one
gives the ids of the whole text.  Pieces are encoded by the ``tokenizers``
library (a piece of letters by its model alone) and kept per Python worker in
a bounded table of two generations, so that words in use stay and rare ones
go; texts with the library's own special markers are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept per worker, half of them in each generation (about 200 bytes each).
CACHE_PIECES = 800_000
#: Pieces longer than this are encoded but not kept.
LONGEST_KEPT = 64

#: Cutting by plain replacement is wrong in texts with three white spaces in a row, two at the end, a comma or
#: dot after another sign (a dotted capital I ends in one once it is lower case).
_ODD = re.compile(r"\s\s\s|\s\s\Z|[\W_\u0130][.,]|\x01")
#: The same test for whole columns (RE2; wider where its classes differ from Python's): all other texts are cut column-wise.
_ODD_COLUMN = r"[\s\v\pZ\x{85}\x1c-\x1f]{3}|[\s\v\pZ\x{85}\x1c-\x1f]{2}$|[^\pL\pN][.,]|\x{130}[.,]|\x01"
#: White space beyond ASCII.
_WIDE_SPACE = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Not cut at all: the library's own markers, and control characters that only Python counts as white space.
_WHOLE_COLUMN = r"<\||[\x1c-\x1f]"
_WITH_SPACE = re.compile(r"\s*\S+|\s+").findall
_NO_SPACE = re.compile(r"\S+").findall
#: One word to a byte-level tokenizer, which takes letters together with the space before them.
_LETTERS = re.compile("\x20?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+").fullmatch
#: One word, and the same after normalising, to a tokenizer that drops space and case (the piece's lower case is tested).
_SMALL_LETTERS = re.compile("[a-z\u00DF-\u00F6\u00F8-\u024F]+").fullmatch
#: Steps before a model that leave a word of small letters as it is, but for its bytes' signs.
_KEEPS_SMALL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUTS_WORDS = {"type": "Split", "behavior": "Removed", "invert": True,
               "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}}


def _byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in prints]
    return {b: 0x100 + i for i, b in enumerate(rest)}


_BYTE_SIGNS = _byte_signs()
_SPACE_SIGN = chr(_BYTE_SIGNS[0x20])


def _as_bytes(lists: list[list[int]]) -> Iterable[bytes]:
    """Each list as little-endian uint32."""
    flat = np.fromiter(chain.from_iterable(lists), "<u4").tobytes()
    at = 0
    for ids in lists:
        yield flat[at:at + 4 * len(ids)]
        at += 4 * len(ids)


def pieces_with_space(text: str) -> list[str]:
    """Pieces of ``text``, each with the white space before it."""
    if _ODD.search(text):
        return _WITH_SPACE(text)
    for sign in " ,.":
        text = text.replace(sign, "\x01" + sign)
    return text.replace("\n", "\x01\n\x01").split("\x01")  # only a space goes with the word behind it


def pieces_without_space(text: str) -> list[str]:
    """Pieces of ``text`` for a tokenizer that drops white space and letter case."""
    text = text.lower() if text.isascii() else text
    if _ODD.search(text):
        return _NO_SPACE(text)
    return text.replace(",", " ,").replace(".", " .").split()


def column_with_space(column: pa.Array) -> pa.Array:
    """``pieces_with_space`` of texts that are not odd: a list of pieces for each, some of them empty."""
    for sign in " ,.":
        column = pc.replace_substring(column, sign, "\x01" + sign)
    return pc.split_pattern(pc.replace_substring(column, "\n", "\x01\n\x01"), "\x01")


def column_without_space(column: pa.Array) -> pa.Array:
    """``pieces_without_space`` of texts that are not odd and hold no white space beyond ASCII."""
    column = pc.if_else(pc.string_is_ascii(column), pc.ascii_lower(column), column)
    for sign in ",.":
        column = pc.replace_substring(column, sign, " " + sign)
    return pc.ascii_split_whitespace(column)


class Encoder:
    """``ids(texts)``: the library's ids of each text as bytes of little-endian uint32.

    ``drops_space``: the tokenizer ignores white space and letter case (its
    normalizer does), so pieces need not tell them apart.
    """

    def __init__(self, path: str, drops_space: bool, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task slot
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.cut, self.cut_column = (pieces_without_space, column_without_space) if drops_space else (pieces_with_space, column_with_space)
        self.odd = f"{_ODD_COLUMN}|{_WIDE_SPACE}" if drops_space else _ODD_COLUMN
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before; pieces found in it come back
        self.limit = cache_pieces // 2
        self.is_word = self._word_test()
        self.letters = self.is_word is _LETTERS  # takes capitals and a space before them too

    def _word_test(self):
        """Test of pieces that the model alone encodes: the tokenizer only splits and maps bytes before it, and such a piece is one word."""
        settings = json.loads(self.tokenizer.to_str())
        model, normalizer, before = (settings[k] or {} for k in ("model", "normalizer", "pre_tokenizer"))
        if model.get("type") != "BPE" or model["dropout"]:
            return None
        if not normalizer and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]:
            test = _LETTERS
        elif (normalizer.get("type") == "Sequence" and all(n in _KEEPS_SMALL for n in normalizer["normalizers"])
              and before.get("type") == "Sequence" and len(before["pretokenizers"]) == 2 and before["pretokenizers"][0] == _CUTS_WORDS
              and before["pretokenizers"][1]["type"] == "ByteLevel" and not before["pretokenizers"][1]["use_regex"]
              and not before["pretokenizers"][1]["add_prefix_space"]):
            def test(piece):
                return _SMALL_LETTERS(piece) and (piece.isascii() or piece == piece.lower())
        else:
            return None
        return None if any(test(a["content"].lower()) or test(a["content"]) for a in settings["added_tokens"]) else test

    def _encode(self, pieces: list[str]) -> Iterable[tuple[str, bytes]]:
        """Pieces with their ids; words go to the model at once, which spares the library's record of every piece."""
        rest, words, signs, is_word = [], [], [], self.is_word or (lambda piece: False)
        for p in pieces:
            if not is_word(p):
                rest.append(p)
            else:
                words.append(p)
                signs.append(p.replace(" ", _SPACE_SIGN) if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_SIGNS))
        yield from zip(rest, self._encode_batch(rest))
        yield from zip(words, _as_bytes([[t.id for t in tokens] for tokens in map(self.tokenizer.model.tokenize, signs)]))

    def _encode_batch(self, pieces: list[str]) -> Iterable[bytes]:
        for lo in range(0, len(pieces), 4096):
            yield from _as_bytes([e.ids for e in self.tokenizer.encode_batch_fast(pieces[lo:lo + 4096], add_special_tokens=False)])

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of ``pieces``, which are different."""
        found = list(map(self.cache.get, pieces))
        if None not in found:
            return found
        lacking = [p for p, ids in zip(pieces, found) if ids is None]
        if len(self.cache) + len(lacking) > self.limit:
            self.cache, self.older = {}, self.cache
        learned = {p: self.older[p] for p in lacking if p in self.older}
        learned.update(self._encode([p for p in lacking if p not in learned]))
        self.cache.update((p, ids) for p, ids in learned.items() if len(p) <= LONGEST_KEPT)
        return [learned[p] if ids is None else ids for p, ids in zip(pieces, found)]

    def ids(self, texts: list[str]) -> list[bytes]:
        return [ids for lo in range(0, len(texts), 256) for ids in self._ids([t or "" for t in texts[lo:lo + 256]])]

    def _ids(self, part: list[str]) -> list[bytes]:
        column = pa.array(part, pa.large_string())
        whole = pc.match_substring_regex(column, _WHOLE_COLUMN)
        odd = pc.and_not(pc.match_substring_regex(column, self.odd), whole)
        by_column, one_by_one, uncut = (np.flatnonzero(m) for m in (pc.invert(pc.or_(odd, whole)), odd, whole))
        lists = self.cut_column(column.take(pa.array(by_column)))
        own = [self.cut(part[i]) for i in one_by_one]
        pieces = pa.concat_arrays([lists.flatten(), pa.array(list(chain.from_iterable(own)), pa.large_string())]).dictionary_encode()
        ids = pa.array(self._known(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pieces.indices)
        counts = np.append(pc.list_value_length(lists).to_numpy(), [len(x) for x in own]).astype(np.int64)
        bounds = np.append(0, np.cumsum(pc.binary_length(ids).to_numpy()))
        ends = bounds[np.append(0, np.cumsum(counts))].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        rows = [b""] * len(part)
        for i, lo, hi in zip([*by_column.tolist(), *one_by_one.tolist()], ends, ends[1:]):
            rows[i] = bytes(data[lo:hi])
        for i in uncut:
            rows[i] = next(iter(self._encode_batch([part[i]])))
        return rows


@lru_cache(maxsize=4)
def encoder(path: str, drops_space: bool) -> Encoder:
    """One encoder per worker process; its table serves all tasks of the worker."""
    return Encoder(path, drops_space)
