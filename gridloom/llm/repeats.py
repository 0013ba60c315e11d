"""Repeated windows across a corpus: the distributed frame that both substring operators share.

Consecutive windows with one minimiser form a *run* and travel as one packed string:

1. one pass over all texts cuts them into runs and writes a slim table of (minimiser's hash, row, run number), beside a row
   per text with its size and digest; the rest reads that table;
2. only runs whose minimiser occurs twice anywhere go on (equal windows have equal minimisers, so none is lost). Hashes that
   hold more than one in ``HEAVY_SHARE`` of the rows, as told by the rows of one text in ``SAMPLE``, are counted by partial
   aggregation and looked up by broadcast, so no task gets all rows of one; the others are counted where they meet;
3. runs go to the bucket of their minimiser. A minimiser with more than ``hot`` occurrences is too common to name a bucket:
   its windows are cut again with minimisers as long as a window, so each is its own packed string in its own bucket, and
   step 2 is done again for these. Equal packed strings are combined before the shuffle, so a group of copies arrives as a
   row per map step however large it is;
4. a bucket's solver marks the repeated windows of each distinct packed string, comparing bytes;
5. marks join the runs again and the texts' spans are handed to the caller, with the text.

The only text shuffle is that of the texts with a repeated minimiser, read again in steps 3 and 5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.llm.common import SLAB, cut, gram_hashes, map_arrow, slabs, super_windows

#: Distinct rows that a bucket's solver gets at once, unless a single minimiser has more.
SOLVE_ROWS = 8_000
#: Packed bytes and rows held back for combining equal strings before they are shuffled.
COMBINE_BYTES = 48 << 20
MAX_ID = (1 << 63) - 1
#: One in this many texts tells which hashes are heavy: those with one in HEAVY_SHARE of the sample's runs or more, so there are
#: at most as many. This settles only how rows are dealt, not the result.
SAMPLE, HEAVY_SHARE = 16, 1_000
#: Up to as many common minimisers are handed to every task; beyond, the texts that have them are found by a join.
LISTED = 50_000


class Symbols:
    """The symbols of several texts that stand one after the other in ``buf``: each text's end, ``part(a, b)`` the 64-bit values
    of symbols a to b - 1, and the bytes (start, stop) of every symbol (None where symbols are bytes)."""

    def __init__(self, buf: np.ndarray, ends: np.ndarray, part: Callable[[int, int], np.ndarray], start: np.ndarray | None = None, stop: np.ndarray | None = None):
        self.raw, self.ends, self.part, self.start, self.stop = buf.tobytes(), ends, part, start, stop
        self.n = int(ends[-1])
        if start is not None and len(start):  # separators that are not one blank, counted
            gap = (start[1:] - stop[:-1] != 1) | (buf[stop[:-1]] != 32)
            self.odd = np.concatenate([[0], np.cumsum(gap)])

    def packed(self, a: int, b: int) -> bytes:
        """The bytes of symbols a to b - 1, words joined by one blank."""
        if self.start is None:
            return self.raw[a:b]
        body = self.raw[self.start[a] : self.stop[b - 1]]
        return body if self.odd[b - 1] == self.odd[a] else b" ".join(body.split())


@dataclass(frozen=True)
class Kind:
    """What a window is made of.

    symbols(bytes, ends) reads texts; solve(h, packs, at, cnt, first) gets rows sorted by minimiser with distinct packs and
    returns for each row a list of window spans [a0, b0, a1, b1 ...) that are repeated for a document with id ``first``.
    own(bytes of a text, number of its symbols) is what is handed on for a text that nothing is taken from.
    ``by_id``: a window counts as repeated in documents with greater ids only.
    """

    window: int
    k: int
    symbols: Callable[[np.ndarray, np.ndarray], Symbols]
    solve: Callable[..., list[list[int]]]
    own: Callable[[bytes], bytes]
    by_id: bool


def run_table(s: Symbols, kind: Kind) -> tuple[np.ndarray, ...]:
    """Runs of all texts of a slab: text, minimiser's hash, its place, first and last window start (places in the slab)."""
    if s.n <= 8 * SLAB:
        return super_windows(s.part(0, s.n), s.ends, kind.window, kind.k)
    parts = []  # one long text
    for a in range(0, s.n - kind.window + 1, SLAB):
        piece = s.part(a, min(s.n, a + SLAB + kind.window - 1))
        d, h, b, s0, s1 = super_windows(piece, np.array([len(piece)]), kind.window, kind.k)
        parts.append((d, h, b + a, s0 + a, s1 + a))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _numbers(row: np.ndarray, rows: int) -> np.ndarray:
    """0, 1, 2 ... within each text; ``row`` ascends."""
    return np.arange(len(row)) - np.searchsorted(row, np.arange(rows))[row]


def _window_hashes(s: Symbols, starts: np.ndarray, kind: Kind) -> np.ndarray:
    """Minimisers as long as a window: a hash of each window itself."""
    out = np.empty(len(starts), np.uint64)
    piece = starts // SLAB
    for p in np.unique(piece).tolist():
        some = piece == p
        out[some] = gram_hashes(s.part(p * SLAB, min(s.n, (p + 1) * SLAB + kind.window - 1)), kind.window)[starts[some] - p * SLAB]
    return out


def _apart(s: Symbols, kind: Kind, row, s0, s1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, code) of every window of some runs; the code is window start * 2 + 1."""
    nw = s1 - s0 + 1
    who = np.repeat(np.arange(len(row)), nw)
    starts = s0[who] + np.arange(len(who)) - np.repeat(np.cumsum(nw) - nw, nw)
    row = row[who]
    return row, _window_hashes(s, starts, kind), (starts - np.concatenate([[0], s.ends[:-1]])[row]) * 2 + 1


def _first_pass(kind: Kind):
    none = lambda n, t: pa.nulls(n, t)

    def run(batches):
        for batch in batches:
            ids, r1, r2 = batch.column("doc_id"), batch.column("r1"), batch.column("r2")
            for lo, hi, buf, ends in slabs(batch):
                s = kind.symbols(buf, ends)
                row, h, *_ = run_table(s, kind)
                code = _numbers(row, hi - lo) * 2
                m, at = len(h), r1.to_numpy()[lo + row]
                counts = np.diff(np.concatenate([[0], s.ends]))
                starts = np.concatenate([[0], ends[:-1]]).tolist()
                own = [kind.own(s.raw[a:b]) for a, b in zip(starts, ends.tolist(), strict=True)]
                yield {
                    "h": pa.concat_arrays([pa.array(h.view(np.int64)), none(hi - lo, pa.int64())]), "r1": np.concatenate([at, r1.to_numpy()[lo:hi]]),
                    "code": np.concatenate([code, np.zeros(hi - lo, np.int64)]),
                    "r2": pa.concat_arrays([none(m, pa.int64()), r2.slice(lo, hi - lo)]), "doc_id": pa.concat_arrays([none(m, pa.int64()), ids.slice(lo, hi - lo)]),
                    "n": pa.concat_arrays([none(m, pa.int64()), pa.array(counts)]), "own": pa.concat_arrays([none(m, pa.binary()), pa.array(own, pa.binary())]),
                }

    return run


def _marked(batch: pa.RecordBatch, lo: int, hi: int) -> np.ndarray:
    """The codes of ``js`` (run number * 2, or window start * 2 + 1) with their row in the slab above bit 40, sorted."""
    js = batch.column("js").slice(lo, hi - lo)
    rows = np.repeat(np.arange(hi - lo), js.value_lengths().to_numpy(zero_copy_only=False))
    return np.sort((rows << 40) | js.flatten().to_numpy(zero_copy_only=False))


def _has(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return sorted_codes[at] == codes


def _hot_windows(kind: Kind, common: np.ndarray | None = None):
    """(h, r1, code) of every window in the runs of ``js``, or in those with a minimiser of ``common`` (sorted)."""

    def run(batches):
        for batch in batches:
            r1 = batch.column("r1").to_numpy()
            for lo, hi, buf, ends in slabs(batch):
                s = kind.symbols(buf, ends)
                row, h, _, s0, s1 = run_table(s, kind)
                some = _has(common, h) if common is not None else _has(_marked(batch, lo, hi), (row << 40) | (_numbers(row, hi - lo) * 2))
                row, h, code = _apart(s, kind, row[some], s0[some], s1[some])
                yield {"h": h.view(np.int64), "r1": r1[lo + row], "code": code}

    return run


def _chosen(batch: pa.RecordBatch, kind: Kind) -> Iterator[tuple[Symbols, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slab its symbols and of the runs and windows named in ``js``: row in the batch, hash, minimiser's place in the packed
    string, first window start in the slab and in the text, windows."""
    for lo, hi, buf, ends in slabs(batch):
        s = kind.symbols(buf, ends)
        row, h, b, s0, s1 = run_table(s, kind)
        codes, begin = _marked(batch, lo, hi), np.concatenate([[0], s.ends[:-1]])
        some = _has(codes, (row << 40) | (_numbers(row, hi - lo) * 2))
        row, h, at, s0, nw = row[some], h[some], (b - s0)[some], s0[some], (s1 - s0 + 1)[some]
        if len(lone := codes[codes & 1 == 1]):
            r, first = lone >> 40, (lone & ((1 << 40) - 1)) >> 1
            lone = lone[first + kind.window <= (s.ends - begin)[r]]  # those of another row under this r1 may lie beyond the text
            r = lone >> 40
            w0 = begin[r] + ((lone & ((1 << 40) - 1)) >> 1)
            one = np.ones(len(r), np.int64)
            row, h, at, s0, nw = (np.concatenate(x) for x in ((row, r), (h, _window_hashes(s, w0, kind)), (at, one - 1), (s0, w0), (nw, one)))
        yield s, lo + row, h.view(np.int64), at, s0, s0 - begin[row], nw


def _names(packs: list[bytes], at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a packed string and its minimiser's place."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, packs, at)), "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _packed_rows(kind: Kind):
    """Distinct packed strings of a task, with how often and in which least document: equal ones are one row."""

    def flush(held):
        keys = list(held)
        vals = list(held.values())
        return {"h": [x[0] for x in keys], "at": [x[1] for x in keys], "pack": [x[2] for x in keys], "n": [v[0] for v in vals], "first": [v[1] for v in vals]}

    def run(batches):
        held, size, more = {}, 0, kind.window - 1
        for batch in batches:
            docs = batch.column("doc_id").fill_null(MAX_ID).to_numpy()
            for s, row, h, at, s0, _, nw in _chosen(batch, kind):
                for doc, key_h, key_at, a, n in zip(docs[row].tolist(), h.tolist(), at.tolist(), s0.tolist(), nw.tolist(), strict=True):
                    key = (key_h, key_at, s.packed(a, a + n + more))
                    if v := held.get(key):
                        v[0] += 1
                        if doc < v[1]:
                            v[1] = doc
                        continue
                    held[key] = [1, doc]
                    size += len(key[2]) + 300
                if size > COMBINE_BYTES:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return run


def _place_rows(kind: Kind):
    def run(batches):
        more = kind.window - 1
        for batch in batches:
            ids, r1, r2 = batch.column("doc_id"), batch.column("r1").to_numpy(), batch.column("r2").to_numpy()
            for s, row, _, at, s0, start, nw in _chosen(batch, kind):
                k1, k2 = _names([s.packed(a, a + n + more) for a, n in zip(s0.tolist(), nw.tolist(), strict=True)], at.tolist())
                yield {"k1": k1, "k2": k2, "doc_id": ids.take(pa.array(row)), "r1": r1[row], "r2": r2[row], "s0": start.astype(np.int32), "nw": nw.astype(np.int32)}

    return run


def _solve_rows(kind: Kind):
    """Rows arrive sorted by h: combine equal packs, hand groups to the solver."""

    def solved(rows):
        h, at, packs, n, first = (list(x) for x in zip(*rows, strict=True))
        spans = kind.solve(h, packs, at, n, first)
        keep = [i for i in range(len(rows)) if spans[i] or n[i] > 1]
        k1, k2 = _names([packs[i] for i in keep], [at[i] for i in keep])
        return {"k1": k1, "k2": k2, "first": [first[i] for i in keep], "spans": [spans[i] for i in keep]}

    def run(batches):
        rows, last = [], {}
        for batch in batches:
            for h, at, pack, n, first in zip(*(batch.column(c).to_pylist() for c in ("h", "at", "pack", "n", "first")), strict=True):
                if rows and rows[-1][0] != h:
                    last = {}
                    if len(rows) >= SOLVE_ROWS:
                        yield solved(rows)
                        rows = []
                if (r := last.get((at, pack))) is not None:
                    r[3] += n
                    r[4] = min(r[4], first)
                    continue
                rows.append(r := [h, at, pack, n, first])
                last[at, pack] = r
        if rows:
            yield solved(rows)

    return run


def _repeated(rows: DataFrame, hot: int) -> DataFrame:
    """rows: h, r1, code, stored. Those whose h occurs more than once, stored; ``many``: runs of more than ``hot``."""
    total, part = rows.count(), F.pmod(F.xxhash64("r1"), F.lit(SAMPLE)) == 0
    often = rows.where(part).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > max(1, total // (SAMPLE * HEAVY_SHARE)))
    heavy, _ = cut(often.select("h", F.lit(True).alias("heavy")), "heavy")
    near = lambda df: F.broadcast(df) if bounded else df
    bounded = heavy.count() <= HEAVY_SHARE
    name = F.when(F.col("heavy"), F.col("h"))
    times = rows.join(near(heavy), "h", "left").groupBy(name.alias("h")).agg(F.count("*").alias("times")).where("h is not null")
    # rows of heavy hashes are spread over all tasks, as their count is known
    rows = rows.join(near(times), "h", "left").withColumn("salt", F.when(F.col("times").isNotNull(), F.col("r1")).otherwise(0))
    n = F.coalesce("times", F.count("*").over(W.partitionBy("h", "salt")))
    found = rows.withColumn("n", n).where("n > 1")
    return cut(found.select("h", "r1", "code", ((F.col("n") > hot) & (F.col("code") % 2 == 0)).alias("many")), "repeated")[0]


def repeated_spans(docs: DataFrame, kind: Kind, hot: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """docs: of ``keyed``. Returns (doc_id, r1, r2, n, own), a row per text, and (r1, r2, m2, body, spans) of texts with the
    places [a, b) of repeated windows' starts, where rows with r2 unequal to m2 are of other texts. A null id is the largest."""
    table, _ = cut(map_arrow(docs, _first_pass(kind), "h long, r1 long, code long, r2 long, doc_id long, n long, own binary"), "runs")
    found = _repeated(table.where("h is not null").select("h", "r1", "code"), hot)
    picked, many = found.where("not many").select("r1", "code"), found.where("many")
    listed = lambda df: df.groupBy("r1").agg(F.collect_set("code").alias("js"))
    texts = lambda js: docs.join(js.hint("merge"), "r1")
    common = [r["h"] for r in many.select("h").distinct().limit(LISTED + 1).collect()]
    if common:
        shape = "h long, r1 long, code long"
        if len(common) <= LISTED:
            windows = map_arrow(docs.select("r1", "body"), _hot_windows(kind, np.sort(np.array(common, np.int64).view(np.uint64))), shape)
        else:
            windows = map_arrow(texts(listed(many)), _hot_windows(kind), shape)
        picked = picked.unionByName(_repeated(cut(windows, "windows")[0], hot).select("r1", "code"))
    chosen = texts(listed(picked))
    found = map_arrow(
        map_arrow(chosen, _packed_rows(kind), "h long, at int, pack binary, n long, first long").repartition("h").sortWithinPartitions("h"),
        _solve_rows(kind), "k1 long, k2 long, first long, spans array<int>",
    )
    places = map_arrow(chosen, _place_rows(kind), "k1 long, k2 long, doc_id long, r1 long, r2 long, s0 int, nw int")
    spans = F.col("spans")
    if kind.by_id:
        spans = F.when(F.coalesce("doc_id", F.lit(MAX_ID)) > F.col("first"), F.array(F.lit(0), F.col("nw"))).otherwise(spans)
    marks = places.join(found.hint("merge"), ["k1", "k2"]).select("r1", "r2", F.transform(spans, lambda x: x + F.col("s0")).alias("spans")).where(F.size("spans") > 0)
    rows = table.where("own is not null").select("doc_id", "r1", "r2", "n", "own")
    marks = marks.groupBy("r1", "r2").agg(F.flatten(F.collect_list("spans")).alias("spans")).withColumnRenamed("r2", "m2")
    return rows, chosen.join(marks.hint("merge"), "r1")  # by r1 only and with all columns, so that the shuffle of texts serves again


def own_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of ``repeated_spans`` whose marks are of their own text."""
    return batch.filter(pc.equal(batch.column("r2"), batch.column("m2")))


def covered(spans: list[int], window: int) -> list[tuple[int, int]]:
    """Merged [a, b) runs of symbols that the windows starting in ``spans`` cover."""
    out: list[list[int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + window - 1)
        else:
            out.append([a, b + window - 1])
    return [(a, b) for a, b in out]
