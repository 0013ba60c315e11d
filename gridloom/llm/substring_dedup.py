"""Word-substring dedup by super-k-mer partitioning.

A super-k-mer is a run of consecutive ``window``-word windows that share a minimiser. It travels as one packed
string to the bucket of that minimiser, and there sorting counts the windows exactly (equal hashes are compared
word by word). A word is removed where a window that covers it also starts in a document with a smaller id.

Null texts have no words; a null id is larger than any other; rows with equal id and text are one document to
each other (neither removes the other), as windows only count from smaller ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SLAB, gram_hashes, keyed, map_arrow, mix, powers
from gridloom.llm.repeats import Kind, Symbols, covered, own_rows, repeated_spans

#: A random 64-bit value per byte; white space (\\x20, \\x09-\\x0D) counts as zero.
BYTES = np.random.default_rng(20_240_103).integers(1, 1 << 64, 256, np.uint64)
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
BYTES[SPACE] = 0


def word_symbols(buf: np.ndarray, ends: np.ndarray) -> Symbols:
    """The words of several texts with polynomial hashes of their bytes, without a step per word."""
    blank = SPACE[buf]
    before = np.concatenate([[True], blank[:-1]])
    before[np.concatenate([[0], ends[:-1]])[ends > np.concatenate([[0], ends[:-1]])]] = True  # a text's first byte
    start = np.flatnonzero(~blank & before)
    after = np.append(before[1:], True)
    stop = np.flatnonzero(~blank & (after | np.append(blank[1:], True))) + 1
    values, lo = np.empty(len(start), np.uint64), 0
    while lo < len(start):  # about SLAB bytes at once, a word at least
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + SLAB)))
        first = start[lo]
        power, inverse = powers(int(stop[hi - 1] - first))
        values[lo:hi] = mix(np.add.reduceat(BYTES[buf[first : stop[hi - 1]]] * power, start[lo:hi] - first) * inverse[start[lo:hi] - first])
        lo = hi
    return Symbols(buf, np.searchsorted(start, ends), lambda a, b: values[a:b], start, stop)


def equal_classes(ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort windows by hash, compare neighbours word by word: (order, first index of each class in that order)."""
    order = np.argsort(hashes[starts], kind="stable")
    sorted_h, s = hashes[starts][order], starts[order]
    near = np.flatnonzero(sorted_h[1:] == sorted_h[:-1])
    same = np.zeros(len(s), bool)
    span = np.arange(window)
    for lo in range(0, len(near), 100_000):
        i = near[lo : lo + 100_000]
        same[i + 1] = (ids[s[i][:, None] + span] == ids[s[i + 1][:, None] + span]).all(axis=1)
    if (odd := near[~same[near + 1]]).size:  # unequal windows under one hash: sort these by their words
        for h in np.unique(sorted_h[odd]):
            lo, hi = np.searchsorted(sorted_h, [h, h], side="left")[0], np.searchsorted(sorted_h, h, side="right")
            keys = [ids[x : x + window].tobytes() for x in s[lo:hi]]
            by = sorted(range(hi - lo), key=keys.__getitem__)
            order[lo:hi], same[lo:hi] = order[lo:hi][by], [i > 0 and keys[by[i]] == keys[by[i - 1]] for i in range(hi - lo)]
            s[lo:hi] = s[lo:hi][by]
    return order, np.flatnonzero(~same)


def flag_spans(flags: np.ndarray, cuts: np.ndarray) -> list[list[int]]:
    """Runs of set flags in each part flags[cuts[i]:cuts[i+1]], as [a0, b0, a1, b1 ...]."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    for_all_a, for_all_b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out: list[list[int]] = [[] for _ in range(len(cuts) - 1)]
    part = np.searchsorted(cuts, for_all_a, side="right") - 1
    for a, b, p in zip(for_all_a.tolist(), for_all_b.tolist(), part.tolist(), strict=True):
        while a < b:  # a run of flags may go on into the next part
            end = min(b, int(cuts[p + 1]))
            if end > a:
                out[p] += [a - int(cuts[p]), end - int(cuts[p])]
            a, p = end, p + 1
    return out


def _solver(window: int):
    def solve(h, packs, at, cnt, first):
        n = len(packs)
        h = np.array(h, np.int64)
        new = np.append(True, h[1:] != h[:-1])
        lone = new & np.append(new[1:], True)
        spans: list[list[int]] = [[] for _ in range(n)]
        rows = np.flatnonzero(~lone)
        if not len(rows):
            return spans
        words = pc.split_pattern(pa.array([packs[i] for i in rows.tolist()], pa.binary()).cast(pa.string()), " ")
        named = words.flatten().dictionary_encode()
        ids = named.indices.to_numpy().astype(np.int64)
        ends = words.offsets.to_numpy()[1:].astype(np.int64)
        lens = np.diff(np.append(0, ends))
        hashes = gram_hashes(mix((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), window)
        nw = lens - window + 1
        cuts = np.concatenate([[0], np.cumsum(nw)])
        rec = np.repeat(np.arange(len(rows)), nw)
        starts = np.arange(cuts[-1]) - cuts[rec] + (ends - lens)[rec]
        order, heads = equal_classes(ids, hashes, starts, window)
        docs = np.array(first, np.int64)[rows][rec]
        least = np.minimum.reduceat(docs[order], heads)
        flags = np.zeros(len(starts), bool)
        flags[order] = np.repeat(least, np.diff(np.append(heads, len(order)))) < docs[order]
        for i, s in zip(rows.tolist(), flag_spans(flags, cuts), strict=True):
            spans[i] = s
        return spans

    return solve


def word_kind(window: int, k: int, digest: bool) -> Kind:
    def own(body: bytes) -> bytes:
        words = b" ".join(body.split())
        return hashlib.sha256(words).digest() if digest else words

    return Kind(window, k, word_symbols, _solver(window), own, by_id=True)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, k: int = 16, hot: int = 20_000, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (``kept``), a row per row of ``docs``.

    ``k``: words of a minimiser. ``hot``: occurrences from which a minimiser's windows each have their own bucket.
    ``digest``: ``kept_sha256`` in place of ``kept``, so that no text is shuffled for the result.
    """

    def clean(batches):
        for batch in map(own_rows, batches):
            kept, removed = [], []
            for body, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = body.split()
                n = 0
                for a, b in reversed(covered(spans, window)):
                    del words[a:b]
                    n += b - a
                text = b" ".join(words)
                kept.append(hashlib.sha256(text).digest() if digest else text)
                removed.append(n)
            yield {"r1": batch.column("r1"), "r2": batch.column("r2"), "n_removed": removed, "kept": kept}

    rows, marked = repeated_spans(keyed(docs, id_col, text_col), word_kind(window, k, digest), hot)
    # equal rows (same id and text) have equal results: one of them is kept
    changed = map_arrow(marked, clean, "r1 long, r2 long, n_removed long, kept binary").dropDuplicates(["r1", "r2"])
    kept = F.coalesce("kept", "own")
    kept = F.lower(F.hex(kept)).alias("kept_sha256") if digest else kept.cast("string").alias("kept")
    return rows.join(changed, ["r1", "r2"], "left").select("doc_id", F.col("n").alias("n_words"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), kept)
