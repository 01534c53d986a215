"""Plain-Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NON_SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, pattern=ALNUM):
    return pattern.findall((text or "").translate(LOW))


def near_duplicates(docs, k=4):
    """docs: (id, text) pairs -> sorted (id, n_shingles, component_id, kept)."""
    sets = []
    for _, text in docs:
        w = words(text, NON_SPACE)
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            inverted[g].append(i)
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in inverted[g] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    rows = [(d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(docs)]
    return sorted(rows, key=str)


def decontaminate(docs, items, window=13):
    wins = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(len(w), window)
        for i in range(len(w) - size + 1) if size else ():
            wins[tuple(w[i:i + size])].add(item)
    out = []
    sizes = {len(x) for x in wins}
    for d, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (key := tuple(w[i:i + size])) in wins:
                    hit.update(range(i, i + size))
                    found |= wins[key]
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((d, len(w), len(hit), len([x for x in found if x is not None]), hashlib.sha256(names.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def remove_repeats(docs, span):
    data = [(t or "").encode() for _, t in docs]
    seen = Counter(b[i:i + span] for b in data for i in range(len(b) - span + 1))
    out = []
    for (d, _), b in zip(docs, data):
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i:i + span]] > 1:
                gone[i:i + span] = b"\1" * span
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def collocations(docs, top=2000, threshold=100, longest=5):
    """docs: (lang, text) pairs."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        good = {p for p, a in c.items() if a >= threshold and len(p) > 1}
        inside = {p[i:i + k] for p in good for k in range(2, len(p)) for i in range(len(p) - k + 1) if c[p] >= c[p[i:i + k]]}
        rows = []
        for p in good - inside:
            score, _, l, r = min((1000 * c[p] * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -c[p], " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out, key=str)


def exact_groups(docs):
    """docs: (id, text) pairs; of rows that repeat the smallest id the first is kept."""
    groups = defaultdict(list)
    for i, (d, text) in enumerate(docs):
        groups[re.sub("[ \t-\r]+", " ", text or "")].append((d is None, d or 0, i))
    out = []
    for text, rows in groups.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        none, keep, first = min(rows)
        out += [(None if x else d, None if none else keep, len(rows), i == first, digest) for x, d, i in rows]
    return sorted(out, key=str)


def planted(doc_id, w):
    """Words of a document after the alteration of one document in ten."""
    if doc_id is None or not w or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def runs(w):
    """All runs of a list of words as (start, length, period), by start, then period."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            part = w[i - q:j]
            if len(part) >= max(6, 4 * q) and not any(all(part[x] == part[x - s] for x in range(s, len(part))) for s in range(1, q)):
                out.append((i - q, len(part), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_report(docs):
    out = []
    for d, text in docs:
        w = planted(d, NON_SPACE.findall(text or ""))
        found = runs(w)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(found), *best, 1000 * best[1] // best[2] if found else None,
                    hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode("utf-8")).hexdigest()))
    return sorted(out, key=str)
