"""Byte-substring dedup by a suffix array of linear grouping construction.

``lyndon_order`` sorts suffixes in two phases. Phase one holds groups of suffixes that share a Lyndon prefix, takes
them from the greatest down, finds each member's previous smaller suffix by following pointers, and moves those
pointed at into new groups just above their old ones, by how many members point at them. Phase two goes through the
order from its start and appends, along the pointers, every suffix to its group: no recursion, no renaming.

Across a corpus (see ``repeats``) consecutive windows with one minimiser travel as one packed string. The bucket's text is
that of all its packed strings from the minimiser on, and a second text holds the bytes before the minimisers backwards.
Both are written in blocks of ``BLOCK`` bytes (counted from the minimiser, so equal texts have equal blocks), numbered in
byte order: the integer alphabet that the construction starts from. The order of the two texts' suffixes, with the common
prefixes of neighbours compared byte by byte, gives each window's class: windows are equal if and only if they agree on
both sides of their minimiser.

Null texts are empty. Rows with equal id and text count as separate occurrences and get equal results.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import keyed, map_arrow
from gridloom.llm.repeats import Kind, Symbols, covered, own_rows, repeated_spans
from gridloom.llm.substring_dedup import flag_spans

BLOCK = 25


def lyndon_order(s: list[int]) -> list[int]:
    """The suffix array of a list of integers (a proper prefix sorts before the longer suffix)."""
    n = len(s)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        by_symbol.setdefault(c, []).append(i)
    members = [by_symbol[c] for c in sorted(by_symbol)]
    group, size = [0] * n, [len(m) for m in members]
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    g_count = len(members)
    lower, upper = list(range(-1, g_count - 1)), list(range(1, g_count + 1))
    if g_count:
        upper[-1] = -1
    done = [False] * g_count
    before = [-1] * n
    g = g_count - 1
    while g >= 0:
        done[g] = True
        pointed: dict[int, int] = {}
        for i in members[g]:
            if group[i] != g:
                continue
            p = i - 1
            while p >= 0 and done[group[p]]:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        split: dict[tuple[int, int], list[int]] = {}
        for p, times in pointed.items():
            split.setdefault((group[p], times), []).append(p)
        for (old, times) in sorted(split, reverse=True):
            moved = split[old, times]
            if len(moved) == size[old]:
                continue  # all that is left of it
            moved.sort()
            new = len(members)
            members.append(moved)
            size.append(len(moved))
            done.append(False)
            size[old] -= len(moved)
            above = upper[old]
            lower.append(old)
            upper.append(above)
            upper[old] = new
            if above >= 0:
                lower[above] = new
            for p in moved:
                group[p] = new
        g = lower[g]
    # phase two: the groups in ascending order are stretches of the result
    place, at, g = [0] * len(members), 0, -1
    for x in range(len(members)):
        if lower[x] == -1:
            g = x
            break
    while g >= 0:
        place[g] = at
        at += size[g]
        g = upper[g]
    order, placed = [-1] * n, [False] * n
    at, i = -1, n
    while True:
        j = i - 1
        while j >= 0 and not placed[j]:
            placed[j] = True
            q = group[j]
            order[place[q]] = j
            place[q] += 1
            j = before[j]
        at += 1
        if at >= n:
            return order
        i = order[at]


def _common(a: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the row above (0 for the first)."""
    out = np.zeros(len(a), np.int64)
    if len(a) > 1:
        same = a[1:] == a[:-1]
        out[1:] = np.where(same.all(axis=1), a.shape[1], np.argmin(same, axis=1))
    return out


def _best(lcp: np.ndarray) -> np.ndarray:
    """The longest common prefix that each has with any other: that with a neighbour."""
    return np.maximum(lcp, np.append(lcp[1:], 0))


def _beside(packs: list[bytes], at: np.ndarray, width: int, forward: bool) -> np.ndarray:
    """A row per packed string: ``width`` bytes from its place on, or those before it backwards; zeros where it ends."""
    flat = np.frombuffer(b"".join(packs), np.uint8)
    lens = np.fromiter(map(len, packs), np.int64, len(packs))
    begin = np.cumsum(lens) - lens
    out, step = np.zeros((len(packs), width), np.uint8), np.arange(width)
    for lo in range(0, len(packs), 2048):
        hi = min(len(packs), lo + 2048)
        places = at[lo:hi, None] + step if forward else at[lo:hi, None] - 1 - step
        there = (places >= 0) & (places < lens[lo:hi, None])
        out[lo:hi][there] = flat[(places + begin[lo:hi, None])[there]]
    return out


def side_order(side: np.ndarray) -> np.ndarray:
    """The rows of a byte matrix in the order of their text, from the suffix array of all rows written in blocks."""
    n, width = side.shape
    blocks = -(-width // BLOCK)
    padded = np.zeros((n, blocks * BLOCK), np.uint8)
    padded[:, :width] = side
    text = np.zeros((n, blocks + 1), np.int64)  # a 0 ends each row
    text[:, :blocks] = np.unique(padded.reshape(-1, BLOCK).view(f"S{BLOCK}").ravel(), return_inverse=True)[1].reshape(n, blocks) + 1
    order = np.array(lyndon_order(text.ravel().tolist()), np.int64)
    return order[order % (blocks + 1) == 0] // (blocks + 1)


def _solver(window: int, k: int):
    width = window - k  # the most bytes before a minimiser within a window

    def solve(h, packs, at, cnt, first):
        spans: list[list[int]] = [[0, len(p) - window + 1] if c > 1 else [] for p, c in zip(packs, cnt, strict=True)]
        h = np.array(h, np.int64)
        new = np.append(True, h[1:] != h[:-1])
        rows = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(rows):
            return spans
        n, own = len(rows), [packs[i] for i in rows.tolist()]
        lead, lens = np.array(at, np.int64)[rows], np.fromiter(map(len, own), np.int64, n)
        after, prior = _beside(own, lead, window, True), _beside(own, lead, width, False)
        order, back = side_order(after), side_order(prior)
        right, left = _common(after[order]), _common(prior[back])
        reach_r, reach_l = np.empty(n, np.int64), np.empty(n, np.int64)
        reach_r[order], reach_l[back] = _best(right), _best(left)
        most, least = lead, lead - (lens - window)  # bytes before the minimiser in the first and the last window
        low, high = np.maximum(least, window - reach_r), np.minimum(most, reach_l)
        nw = lens - window + 1
        cuts = np.concatenate([[0], np.cumsum(nw)])
        flags = np.zeros(cuts[-1], bool)
        live = np.flatnonzero(low <= high)
        if len(live):
            for x in range(int(low[live].min()), int(high[live].max()) + 1):
                rs = live[(low[live] <= x) & (x <= high[live])]
                if not len(rs):
                    continue
                class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
                class_r[order], class_l[back] = np.cumsum(right < window - x), np.cumsum(left < x)
                key = class_r[rs] * (n + 1) + class_l[rs]
                _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
                hit = rs[times[inverse] > 1]
                flags[cuts[hit] + lead[hit] - x] = True
        for i, found in zip(rows.tolist(), flag_spans(flags, cuts), strict=True):
            if cnt[i] == 1:
                spans[i] = found
        return spans

    return solve


TABLE = np.random.default_rng(20_240_101).integers(0, 1 << 64, 256, np.uint64)


def byte_kind(window: int, k: int, digest: bool) -> Kind:
    def own(body: bytes) -> bytes:
        return hashlib.sha256(body).digest() if digest else body

    return Kind(window, k, lambda buf, ends: Symbols(buf, ends, lambda a, b: TABLE[buf[a:b]]), _solver(window, k), own, by_id=False)


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, k: int = 64, hot: int = 20_000, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes (``kept``), a row per row of ``docs``.

    A byte goes if a ``window``-byte string that covers it also starts elsewhere, in the same text included.
    ``hot``: occurrences from which a minimiser's windows each have their own bucket; ``digest``: ``kept_sha256`` only.
    """

    def clean(batches):
        for batch in map(own_rows, batches):
            kept, removed, n_spans = [], [], []
            for body, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                parts, end, n = [], 0, 0
                runs = covered(spans, window)
                for a, b in runs:
                    parts.append(body[end:a])
                    end = b
                    n += b - a
                parts.append(body[end:])
                rest = b"".join(parts)
                kept.append(hashlib.sha256(rest).digest() if digest else rest)
                removed.append(n)
                n_spans.append(len(runs))
            yield {"r1": batch.column("r1"), "r2": batch.column("r2"), "n_removed": removed, "n_spans": n_spans, "kept": kept}

    rows, marked = repeated_spans(keyed(docs, id_col, text_col), byte_kind(window, k, digest), hot)
    # equal rows (same id and text) have equal results: one of them is kept
    changed = map_arrow(marked, clean, "r1 long, r2 long, n_removed long, n_spans long, kept binary").dropDuplicates(["r1", "r2"])
    kept = F.coalesce("kept", "own")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(changed, ["r1", "r2"], "left").select("doc_id", F.col("n").alias("n_bytes"), zero("n_removed"), zero("n_spans"), F.lower(F.hex(kept)).alias("kept_sha256") if digest else kept.alias("kept"))
