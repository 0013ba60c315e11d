"""Plain-Python versions of the corpus operators' contracts, over lists of rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def rules(rows):
    out = []
    for d, t in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        dup = sum(x in lines[:i] for i, x in enumerate(lines))
        g = Counter(zip(w, w[1:], w[2:]))
        hit = set()
        for i, x in enumerate(zip(w, w[1:], w[2:])):
            if g[x] > 1:
                hit |= {i, i + 1, i + 2}
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    return out


def suffixes(rows, window=200):
    seen = Counter()
    bodies = [(t or "").encode() for _, t in rows]
    for b in bodies:
        seen.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for (d, _), b in zip(rows, bodies):
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(kept)))
    return out


def substrings(rows, window=50):
    least = {}
    big = 1 << 62
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in docs:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, big), big if d is None else d)
    out = []
    for d, w in docs:
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (big if d is None else d):
                gone[i : i + window] = b"\1" * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contamination(rows, items, window=10):
    wins = defaultdict(set)
    for item, t in items:
        w = TERM.findall((t or "").translate(LOWER))
        if w:
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                wins[tuple(w[i : i + n])].add(item)
    sizes = {len(k) for k in wins}
    out = []
    for d, t in rows:
        w = TERM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[k]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(str(x) for x in found))), bool(hit)))
    return out


def simhash(rows, threshold=3, shingle=3):
    fps = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        s = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    names = sorted(set(fps))
    parent = {f: f for f in names}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= threshold:
                parent[root(a)] = root(b)
    least = {}
    for (d, _), f in zip(rows, fps):
        if d is not None:
            least[root(f)] = min(least.get(root(f), d), d)
    return [(d, f"{f:016x}", least.get(root(f))) for (d, _), f in zip(rows, fps)]


def warc(rows, least=100):
    by = {}
    for p, html in rows:
        b = (html or "").encode()
        if len(b) >= least and p is not None:
            by[b] = min(by.get(b, p), p)
    out = []
    for p, html in rows:
        b = (html or "").encode()
        first = by.get(b)
        again = first is not None and first != p
        out.append((p, len(b), sha(b), "revisit" if again else "response", first if again else None))
    return out


def crc(text):
    return zlib.crc32((text or "").encode())


def kept(rows):
    """The rules of the cascade, one after the other, without an order that matters."""
    out = []
    for (d, t), (_, n, chars, symbols, dup, repeat, failed) in zip(rows, rules(rows)):
        t = t or ""
        lines = [x for x in t.split("\n") if WORD.search(x)]
        upper, letters = len(re.findall("[A-Z]", t)), len(re.findall("[A-Za-z]", t))
        bad = symbols > 0.1 * n or not 2 * n <= chars <= 12 * n or dup > 0.4 * len(lines) or (letters > 20 and upper > 0.5 * letters) or t.count("!!") > 0.2 * n
        out.append((d, not (failed or bad)))
    return out


def shards(rows, shards, seed=17):
    """rows: id, source, crc. (id, shard, slot): rows of a source by the seeded hash, all by fractional rank, cut evenly."""

    def h64(*values):
        h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
        for v in values:
            if v is not None:
                h = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), h)
        return h - (1 << 64) if h >> 63 else h

    by = defaultdict(list)
    for d, s, c in rows:
        h = h64(d, c)
        by[s].append(((h & (1 << 64) - 1) >> 1, h, (d is not None, d), c))
    placed = sorted(((i + 0.5) / len(x), *row) for x in by.values() for i, row in enumerate(sorted(x)))
    out, at = [], 0
    for k in range(shards):
        n = len(placed) // shards + (k < len(placed) % shards)
        out += [(row[3][1], k, j) for j, row in enumerate(placed[at : at + n])]
        at += n
    return out
