"""Secret detection: fixed patterns and a linear-chain conditional random field.

Tokens are runs of non-space characters; a line is a sequence.  The field tags
each token as the beginning of a secret, inside one, or outside.  Features of a
token: its shape (length, mixture of letters, digits and signs, how often the
class changes), the words before and after it, cue words in it, and features
of the whole text (size, share of digits and signs).  Emissions are sums of
weights of hashed features; transitions are a 3 x 3 table.  Decoding is
Viterbi over all lines of an Arrow batch at a time.

The field is trained here, by maximum likelihood on the driver, on a bounded
sample (``TRAIN_DOCS`` documents of at most ``TRAIN_CHARS`` characters) and on
a passage of each with made-up secrets and harmless look-alikes put in, under
key words, separators and quotes that the patterns do not know.  Secrets that
the patterns match are labelled, so are the made-up ones; other tokens that
look random are left open (summed over their tags), the rest is outside.  The
token itself is a feature only if it is a word, so the field cannot learn
secrets by heart.

The patterns' spans always stay; the field adds every span that they don't
cover whole, without quotes, brackets and punctuation around it.  Texts of over
``PART_BYTES`` bytes are tagged part by part, cut between tokens.

Defined results: NULL texts are empty; empty texts have no spans; rows that
repeat a doc_id are scanned one by one; extra columns are carried by
``redact`` and ignored by ``find_secrets``.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.text_kernel import LOWER, NON_SPACE, PART_BYTES, part_ends, row_slices, text_bytes, words_of

#: Fixed values of the contract: kind, pattern, group whose length counts, its least length.
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]
KINDS = ["assign", "access", "hex", "crf"]
#: A text without any of these has no base span (checked before the patterns run).
_MAY = re.compile(r"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}", re.A)

TRAIN_DOCS = 400
#: Characters of a text in the sample, at most (longer ones are not drawn).
TRAIN_CHARS = 20_000
#: Tokens of the sample whose pairs and features are summed at a time (about 400 bytes each), and bytes whose tokens are made at a time.
TRAIN_TOKENS = 1 << 14
TRAIN_SLICE = 128 << 10
WEIGHTS = 1 << 14
FEATURES = 14
EPOCHS = 30
#: Log-odds by which the tagged path must beat "all outside" on the span's tokens.
MARGIN = 4.0
OUT, BEGIN, INSIDE = 0, 1, 2


def _matches(text: str) -> list[tuple[str, int, int, int]]:
    """Kind, start, end and start of the secret itself of every base span."""
    if not _MAY.search(text):
        return []
    out = []
    for kind, pattern, group, least in BASE:
        out += [(kind, m.start(), m.end(), m.start(group)) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that are long enough (code points)."""
    return [(kind, a, b) for kind, a, b, _ in _matches(text)]


def merged(spans) -> list[tuple[int, int]]:
    """Disjoint ranges in order that together hold the (start, end) of ``spans``."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end, ordered by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


# --- features ------------------------------------------------------------------

_CLASS = np.full(256, 3, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 sign, 4 other letters
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 0, 1, 2, 4


#: Bytes of texts whose tokens are tagged together: a byte takes about 100 bytes of sums and features.
SCAN_BYTES = 512 << 10


class Tokens:
    """Tokens of a range of texts with feature ids, and the line each is in."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        words = words_of(buf, offsets, NON_SPACE)
        self.start, self.end = words.start, words.end
        n = len(self.start)
        self.row = np.repeat(np.arange(len(offsets) - 1), words.counts)
        newline = np.append(0, np.cumsum(buf == 0x0A))
        line = newline[self.start]
        self.fresh = np.ones(n, bool)  # begins a sequence
        if n:
            self.fresh[1:] = (line[1:] != line[:-1]) | (self.row[1:] != self.row[:-1])
        if n:
            self.features = self._features(buf, offsets - offsets[0], words.hash)
        else:
            self.features, self.odd = np.zeros((0, FEATURES), np.int32), np.zeros(0, bool)

    @classmethod
    def in_slices(cls, buf: np.ndarray, offsets: np.ndarray, size: int = SCAN_BYTES) -> Tokens:
        """The same tokens, made from slices of rows: the sums over bytes are held for one slice at a time."""
        parts = [(lo, int(offsets[lo]), cls(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])) for lo, hi in row_slices(offsets, size)]
        if not parts:
            return cls(buf, offsets)
        out = cls.__new__(cls)
        out.start, out.end = (np.concatenate([getattr(t, k) + at for _, at, t in parts]) for k in ("start", "end"))
        out.row = np.concatenate([t.row + lo for lo, _, t in parts])
        out.fresh, out.features, out.odd = (np.concatenate([getattr(t, k) for _, _, t in parts]) for k in ("fresh", "features", "odd"))
        return out

    def _features(self, buf, offsets, word):
        kind = _CLASS[buf]
        size = self.end - self.start
        sums = [np.append(0, np.cumsum(kind == c)) for c in range(5)]
        count = [s[self.end] - s[self.start] for s in sums]
        change = np.append(0, np.cumsum(np.append(False, kind[1:] != kind[:-1])))
        changes = change[self.end] - change[self.start + 1]  # inside the token: the row before is no part of it
        equals = np.append(0, np.cumsum((buf == 0x3D) | (buf == 0x3A)))
        has_equal = (equals[self.end] - equals[self.start] > 0).astype(np.int64)
        bucket = np.minimum(np.log2(size + 1) * 3, 31).astype(np.int64)
        share = [np.minimum(4 * c // np.maximum(size, 1), 3) for c in count]
        some = sum((np.minimum(c, 1) << i) for i, c in enumerate(count))
        shape = share[0] + 4 * share[1] + 16 * share[2] + 64 * share[3]
        turn = np.minimum(8 * changes // np.maximum(size, 1), 7)
        # looks random: long, of letters and digits that take turns
        self.odd = (size >= 16) & (count[2] > 0) & (count[0] + count[1] > 0) & (changes >= 4)
        # the token itself, if it is short and has no digits
        cue = np.where((size <= 20) & (count[2] == 0), (word >> np.uint64(20)).astype(np.int64), -1)
        before = np.append(0, cue[:-1]) * ~self.fresh
        last = np.append(self.fresh[1:], True)
        after = np.append(cue[1:], 0) * ~last
        prev_shape = np.append(0, (some + 32 * has_equal)[:-1]) * ~self.fresh
        next_shape = np.append(some[1:], 0) * ~last
        # the whole text: its size and how much of it is digits and signs
        length = np.diff(offsets)
        odd = (sums[2] + sums[3])[offsets[1:]] - (sums[2] + sums[3])[offsets[:-1]]
        text = np.minimum(np.log2(length + 1), 31).astype(np.int64) + 32 * np.minimum(16 * odd // np.maximum(length, 1), 15)
        edge = LOWER[buf[self.start]].astype(np.int64) + 256 * LOWER[buf[self.end - 1]].astype(np.int64)
        columns = [np.zeros(len(size), np.int64), bucket, shape, some + 32 * has_equal, turn + 8 * bucket, cue, before, after,
                   prev_shape, next_shape, text[self.row], edge, some + 32 * bucket, turn + 8 * (some + 32 * has_equal)]
        ids = np.empty((len(size), FEATURES), np.int32)
        for i, c in enumerate(columns):
            salt = np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            h = (c.astype(np.uint64) + salt) * np.uint64(0xFF51AFD7ED558CCD)
            ids[:, i] = ((h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(50)).astype(np.int32)
        return ids

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.start), 3), np.float32)
        for i in range(FEATURES):
            out += weights[self.features[:, i]]
        return out


def _by_length(fresh: np.ndarray):
    """Sequences ordered by falling length: first token of each, and lengths."""
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(fresh)))
    order = np.argsort(-size, kind="stable")
    return first[order], size[order]


def viterbi(emit: np.ndarray, step: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Best tags of all sequences side by side (``step[i, j]``: from tag i to tag j).

    A sequence is outside throughout if no token's other tags gain more over
    "outside" than the two transitions next to it can cost; only the others
    are decoded.
    """
    n = len(emit)
    tags = np.zeros(n, np.int8)
    if not n:
        return tags
    gain = emit[:, 1:].max(1) - emit[:, OUT] + 2 * max(0.0, float(step.max() - step[OUT, OUT]))
    first = np.flatnonzero(fresh)
    some = np.add.reduceat(gain > 0, first) > 0
    size = np.diff(np.append(first, n))
    first, size = first[some], size[some]
    if not len(first):
        return tags
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    lives = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]) + 1)]  # sequences longer than t
    back = np.zeros((n, 3), np.int8)
    score = emit[first] + step[OUT]  # a line starts as if after an outside token
    last = np.empty((len(first), 3), np.float32)
    for t in range(1, int(size[0]) + 1):
        live = lives[t]
        last[live:lives[t - 1]] = score[live:lives[t - 1]]
        if not live:
            break
        score = score[:live]
        at = first[:live] + t
        new = emit[at]
        for j in range(3):
            best, top = np.zeros(live, np.int8), score[:, 0] + step[0, j]
            for i in (1, 2):
                path = score[:, i] + step[i, j]
                more = path > top
                best[more] = i
                top = np.maximum(top, path)
            back[at, j] = best
            new[:, j] += top
        score = new
    now = last.argmax(1).astype(np.int8)
    tags[first + size - 1] = now
    for t in range(int(size[0]) - 1, 0, -1):
        at = first[:lives[t]] + t
        tags[at - 1] = back[at, tags[at]]
    return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(emit: np.ndarray, step: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: tag probabilities of each token and expected transitions."""
    first, size = _by_length(fresh)
    n, longest = len(first), int(size[0])
    alpha = np.empty((len(emit), 3))
    beta = np.zeros((len(emit), 3))
    alpha[first] = emit[first] + step[OUT]
    lives = [int(np.searchsorted(-size, -t, "left")) for t in range(longest)]
    for t in range(1, longest):
        at = first[:lives[t]] + t
        alpha[at] = _log_sum(alpha[at - 1][:, :, None] + step[None], 1) + emit[at]
    for t in range(longest - 1, 0, -1):
        at = first[:lives[t]] + t
        beta[at - 1] = _log_sum(step[None] + (emit[at] + beta[at])[:, None, :], 2)
    whole = _log_sum(alpha[first + size - 1], 1)
    seq = np.empty(n, np.int64)
    seq[np.argsort(first)] = np.arange(n)
    total = np.empty(len(emit))
    for f, s, z in zip(first, size, whole):
        total[f:f + s] = z
    later = np.flatnonzero(~fresh)
    moves = np.zeros((3, 3))
    for lo in range(0, len(later), TRAIN_TOKENS):  # the sum so far comes first, so the order of adding is that of one sum
        at = later[lo:lo + TRAIN_TOKENS]
        pair = alpha[at - 1][:, :, None] + step[None] + (emit[at] + beta[at])[:, None, :] - total[at][:, None, None]
        moves = np.concatenate([moves[None], np.exp(pair)]).sum(0)
    alpha += beta
    alpha -= total[:, None]
    prob = np.exp(alpha, out=alpha)
    moves[OUT] += prob[first].sum(0)
    return prob, moves


def _by_feature(features: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the tokens' ``values`` for each hashed feature."""
    out, own = np.zeros(WEIGHTS), np.arange(WEIGHTS)
    for lo in range(0, len(features), TRAIN_TOKENS):
        part = features[lo:lo + TRAIN_TOKENS]
        out = np.bincount(np.append(own, part.ravel()), np.append(out, np.repeat(values[lo:lo + TRAIN_TOKENS], FEATURES)), WEIGHTS)
    return out


def _token_ranges(spans, text: str, offset: int, tokens: Tokens):
    """First and last + 1 token that each span (code points of ``text``, whose bytes start at ``offset``) touches."""
    for a, b in merged(spans):
        lo = offset + len(text[:a].encode())
        hi = lo + len(text[a:b].encode())
        i, j = np.searchsorted(tokens.end, lo, "right"), np.searchsorted(tokens.start, hi, "left")
        if i < j:
            yield int(i), int(j)


def gold_tags(texts: list[str], tokens: Tokens, byte_offsets: np.ndarray, spans=None) -> np.ndarray:
    """Tags of tokens by ``spans`` of each text (default: the secrets that the patterns match).

    A token that a span touches belongs to it.
    """
    tags = np.zeros(len(tokens.start), np.int8)
    for r, text in enumerate(texts):
        own = [(v, b) for _, _, b, v in _matches(text)] if spans is None else spans[r]
        for i, j in _token_ranges(own, text, int(byte_offsets[r]), tokens):
            tags[i] = BEGIN
            tags[i + 1:j] = INSIDE
    return tags


# --- made-up examples -------------------------------------------------------------

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LEADS = ["auth", "credential", "pwd", "key", "bearer", "private", "access", "signing", "session", "login"]
_JOINS = [" = ", ": ", "=", ":", " -> ", " := ", " => ", " is ", " "]
_QUOTES = ["", "", '"', "'", "`"]


def _draw(rng, letters: str, n: int) -> str:
    return "".join(letters[i] for i in rng.integers(0, len(letters), n))


def made_secret(rng) -> str:
    """A random key of 16 to 64 characters in one of several alphabets."""
    n = int(rng.integers(16, 65))
    letters = [_DIGITS + "abcdef", _DIGITS + "ABCDEF", _DIGITS + _LOWER + _UPPER, _DIGITS + _LOWER + _UPPER + "+/",
               _DIGITS + _UPPER, _DIGITS + _LOWER][rng.integers(0, 6)]
    form = rng.integers(0, 4)
    if form == 0:
        return "-".join(_draw(rng, letters, 6) for _ in range(max(3, n // 7)))
    if form == 1:
        return _draw(rng, _LOWER, int(rng.integers(2, 5))) + "_" + _draw(rng, letters, n)
    return _draw(rng, letters, n) + "=" * int(rng.integers(0, 3) if form == 2 else 0)


def made_harmless(rng) -> str:
    """Something of digits, letters and signs that is no secret."""
    word = lambda a=3, b=11: _draw(rng, _LOWER, int(rng.integers(a, b)))
    number = lambda a, b: str(rng.integers(1, 10)) + _draw(rng, _DIGITS, int(rng.integers(a, b)))
    return [
        lambda: f"{word()}.{number(0, 3)}@{word()}{number(0, 2)}.{word(3, 9)}.{word(2, 4)}",
        lambda: f"https://{word()}.{word(2, 4)}/{word()}/{word()}-{word()}-{number(1, 8)}.html",
        lambda: f"20{_draw(rng, _DIGITS, 2)}-0{number(0, 1)}-1{number(0, 1)}T1{number(0, 1)}:2{number(0, 1)}:{number(1, 2)}Z",
        lambda: number(3, 24),
        lambda: f"+{number(1, 2)}-{number(2, 3)}-{number(3, 8)}",
        lambda: f"v{number(0, 1)}.{number(0, 2)}.{number(0, 3)}-{word()}{number(0, 2)}",
        lambda: f"{word()}_{word()}_{number(0, 4)}.{word(2, 4)}",
        lambda: f"/{word()}/{word()}/{word()}{number(0, 2)}/{word()}.{word(2, 4)}",
        lambda: f"{word()}-{word()}-{word()}-{word()}",
        lambda: word(16, 30),
        lambda: word(16, 30).upper(),
    ][rng.integers(0, 11)]()


def planted(text: str, rng, leads=_LEADS, joins=_JOINS, words: int = 200):
    """A passage of ``text`` with made-up secrets and harmless tokens between its words.

    Returns the passage, and the spans (code points) of the secrets and of the harmless tokens.
    """
    parts = [p for p in re.split(r"( +)", text) if p.strip(" ")]
    at = int(rng.integers(0, max(1, len(parts) - words)))
    out, secrets, harmless, n = [], [], [], 0

    def put(piece):
        nonlocal n
        out.append(piece)
        n += len(piece)
    parts = parts[at:at + words]
    for p in [*parts, ""]:
        dice = rng.random()
        if dice < 0.02 or not p:
            lead = str(rng.choice(leads)) if rng.random() < 0.6 else str(rng.choice(parts)) if parts else ""
            quote = str(rng.choice(_QUOTES))
            put(lead + str(rng.choice(joins)) + quote)
            value = made_secret(rng)
            secrets.append((n, n + len(value)))
            put(value + quote + " ")
        elif dice < 0.05:
            value = made_harmless(rng)
            if rng.random() < 0.3:  # a key word alone makes no secret
                put(str(rng.choice(leads)) + str(rng.choice(joins)))
            harmless.append((n, n + len(value)))
            put(value + " ")
        put(p + " ")
    return "".join(out), secrets, harmless


def train(texts: list[str], epochs: int = EPOCHS, rate: float = 0.15, decay: float = 1e-4, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights (WEIGHTS x 3) and transitions by gradient ascent on the likelihood of the known tags.

    Tokens left open take part with all tags: the gradient is the expectation
    under the known tags less the expectation under none.
    """
    weights, step = np.zeros((WEIGHTS, 3), np.float32), np.zeros((3, 3), np.float32)
    step[OUT, INSIDE] = -20.0  # inside follows begin or inside
    rng = np.random.default_rng(seed)
    made = [planted(t, rng) for t in texts]
    buf, offsets = text_bytes(pa.array(texts + [m[0] for m in made], pa.string()))
    tokens = Tokens.in_slices(buf, offsets, TRAIN_SLICE)
    if not len(tokens.start):
        weights[:, BEGIN:] = -1.0
        return weights, step
    texts = texts + [m[0] for m in made]
    matched = [[(v, b) for _, _, b, v in _matches(t)] for t in texts]
    tags = gold_tags(texts, tokens, offsets, [x + y for x, y in zip(matched, [[]] * len(made) + [m[1] for m in made])])
    known = (tags != OUT) | ~tokens.odd
    for r, (text, (_, _, harmless)) in enumerate(zip(texts[len(made):], made), len(made)):
        for i, j in _token_ranges(harmless, text, int(offsets[r]), tokens):
            known[i:j] = True
    closed = known[:, None] & (np.arange(3) != tags[:, None])
    n, f = len(tags), tokens.features
    before = np.where(tokens.fresh, OUT, np.append(OUT, tags[:-1]))
    moves = np.zeros((3, 3))
    np.add.at(moves, (before, tags), 1)
    # begin at the transitions' smoothed frequencies
    step[:] = np.log((moves + 0.1) / (moves + 0.1).sum(1, keepdims=True))
    step[OUT, INSIDE] = -20.0
    both = [weights, step]
    mean, square = [np.zeros_like(x) for x in both], [np.zeros_like(x) for x in both]
    for t in range(1, epochs + 1):  # Adam on the log-likelihood
        emit = tokens.emissions(weights).astype(float)
        prob, moves = marginals(emit, step.astype(float), tokens.fresh)
        emit[closed] -= 50.0
        delta, gold_moves = marginals(emit, step.astype(float), tokens.fresh)
        delta -= prob
        grads = [np.stack([_by_feature(f, delta[:, c]) for c in range(3)], 1) - decay * n * weights / WEIGHTS,
                 gold_moves - moves]
        for k, grad in enumerate(grads):
            mean[k] = 0.9 * mean[k] + 0.1 * grad
            square[k] = 0.99 * square[k] + 0.01 * grad ** 2
            both[k] += (rate * (mean[k] / (1 - 0.9 ** t)) / (np.sqrt(square[k] / (1 - 0.99 ** t)) + 1e-8)).astype(np.float32)
        step[OUT, INSIDE] = -20.0
    return weights, step


def _covered(a: int, b: int, ranges: list[tuple[int, int]]) -> bool:
    """Whether one of the disjoint ranges, which are in order, holds all of a..b."""
    i = bisect_right(ranges, (a, float("inf"))) - 1
    return i >= 0 and ranges[i][1] >= b


#: Characters around a secret that are no part of it.
_AROUND = "\"'`()[]{}<>,;:.!?#$%&*|"


def field_spans(buf: np.ndarray, offsets: np.ndarray, model) -> list[tuple[int, int, int]]:
    """(row, start, end) of the field's spans of tokens, in bytes of ``buf``."""
    tokens = Tokens(buf, offsets)
    if not len(tokens.start):
        return []
    weights, step = model
    emit = tokens.emissions(weights)
    tags = viterbi(emit, step, tokens.fresh)
    hits = np.flatnonzero(tags != OUT)
    if not len(hits):
        return []
    starts = np.append(True, (np.diff(hits) > 1) | (tags[hits[1:]] == BEGIN) | tokens.fresh[hits[1:]])
    first = np.flatnonzero(starts)
    sure = np.add.reduceat((emit.max(1) - emit[:, OUT])[hits], first) >= MARGIN
    last = np.append(first[1:], len(hits)) - 1
    return [(int(tokens.row[i]), int(tokens.start[i]), int(tokens.end[j])) for i, j in zip(hits[first[sure]], hits[last[sure]])]


def _own_spans(buf: np.ndarray, offsets: np.ndarray, found, base) -> list[list[tuple[str, int, int]]]:
    """The field's spans per row as code points, trimmed; those that base spans hold whole are left out."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in base]
    chars, taken = None, {}
    for r, lo, hi in found:
        if chars is None:  # code points before each byte
            chars = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
        if r not in taken:
            taken[r] = merged((a, b) for _, a, b in base[r])
        raw = buf[lo:hi].tobytes().decode()
        a = int(chars[lo] - chars[offsets[r]]) + len(raw) - len(raw.lstrip(_AROUND))
        b = a + len(raw.strip(_AROUND))
        if a < b and not _covered(a, b, taken[r]):
            out[r].append(("crf", a, b))
    return out


def scan(column, model, part: int = PART_BYTES) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, field spans) of each text of an Arrow string column."""
    result = []
    buf, offsets = text_bytes(column)
    for lo, hi in row_slices(offsets, min(part, SCAN_BYTES)):
        texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
        base = [base_spans(t) for t in texts]
        cut, piece = offsets[lo:hi + 1] - offsets[lo], buf[offsets[lo]:offsets[hi]]
        if len(piece) <= part:
            found = field_spans(piece, cut, model)
        else:  # one long text
            ends = part_ends(piece, NON_SPACE, part)
            found = [(0, x + a, x + b) for x, y in zip([0, *ends[:-1]], ends)
                     for _, a, b in field_spans(piece[x:y], np.array([0, y - x]), model)]
        result += list(zip(base, _own_spans(piece, cut, found, base)))
    return result


# --- Spark jobs ------------------------------------------------------------------

def fit(docs: DataFrame, sample: int = TRAIN_DOCS):
    """Train on at most ``sample`` different texts: half of those a pattern may match, half of any.

    They are the first in a hash order.  A threshold on the hash leaves about
    four times as many before they are sorted, so what tasks send to the driver
    doesn't grow with the input.
    """
    text = docs.select(F.col("text").cast("string").alias("text")).where(F.length("text") <= TRAIN_CHARS)
    may = text.where(F.col("text").rlike(r"(?i)passw|secret|token|api_?key|AKIA|[0-9a-f]{24}"))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    picked = []
    for part in (may, text):
        n = part.select(F.xxhash64("text")).distinct().count()  # different texts: copies take no place in the sample
        few = part.withColumn("place", place).where(F.col("place") * F.lit(n) <= 2 * sample).distinct()
        picked += [r["text"] for r in few.orderBy("place", "text").limit(sample // 2).collect()]
    return train(picked)


def find_secrets(docs: DataFrame, model=None) -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end>>`` for every row of ``docs``: base spans and the field's."""
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches):
        for batch in batches:
            found = scan(batch.column(1), held.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in
                                             sorted(x + y, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))] for x, y in found], _SPANS)],
                names=["doc_id", "spans"])
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def secret_report(docs: DataFrame, model=None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs``."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = find_secrets(docs, model)
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def blank_out(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model=None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by a mark; all columns and rows stay, NULL texts too."""
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs.select(F.col(text_col).alias("text"))))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            column = batch.column(at).cast(pa.string())
            spans = [x + y for x, y in scan(column, held.value)]
            some = np.array([bool(s) for s in spans], bool)  # only these texts become Python objects and new values
            done = [blank_out(column[i].as_py(), spans[i]) for i in np.flatnonzero(some).tolist()]
            yield batch.set_column(at, text_col, pc.replace_with_mask(column, pa.array(some), pa.array(done, pa.string())))
    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, docs.withColumn(text_col, F.col(text_col).cast("string")).schema)
