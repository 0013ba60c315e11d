"""Line dedup by content-defined chunks.

A rolling hash over the hashes of ``reach`` lines marks a chunk's end where it falls under a threshold, so the same
passage has the same inner boundaries wherever it stands and an inserted line shifts nothing; ``most`` lines end a chunk in any
case (the one boundary that depends on a place: in a longer stretch without a natural boundary, as of equal lines, an
inserted line shifts the chunks up to the next natural one). Chunks of two lines or more with a word that occur in several
places of the corpus are removed everywhere but at their first place (least id, then place). Chunks are found by 128-bit
digests, and those whose digest repeats are then grouped by their bytes, which decide.

Lines end at ``\\n`` and keep it. Null texts have no lines and come back null; rows with equal id and text count as one
place each and get equal results. Null ids come after all others. Texts may be of any length that Spark holds; empty tables
give empty results.

Boundaries are missing from many short passages, which then stay. ``repeated_lines`` draws none: it finds every run of
lines that an earlier place has, by 128-bit digests of windows of lines; ``dedup_lines`` and ``line_run_report`` use it.
"""

from __future__ import annotations

import hashlib
import struct
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, free_names, gram_hashes, handing_back, keyed, map_arrow, row_key, small_batches

DIGEST = struct.Struct("<qq")


def chunk_spans(body: bytes, reach: int = 2, mean: int = 4, most: int = 64) -> list[tuple[int, int, int]]:
    """(start byte, end byte, lines) of the chunks of a text; ``most`` lines end a chunk in any case."""
    lines = _lines(body)
    if not lines:
        return []
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
    ends = np.cumsum([len(x) for x in lines])
    cut = np.zeros(len(lines), bool)
    cut[reach - 1 :] = gram_hashes(hashes, reach) < np.uint64((1 << 64) // mean)
    cut[-1] = True
    out, first, start = [], 0, 0
    for i in np.flatnonzero(cut).tolist():
        while i - first + 1 > most:
            out.append((start, int(ends[first + most - 1]), most))
            first, start = first + most, int(ends[first + most - 1])
        out.append((start, int(ends[i]), i - first + 1))
        first, start = i + 1, int(ends[i])
    return out


def _lines(body: bytes) -> list[bytes]:
    parts = body.split(b"\n")
    return [p + b"\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def _digest(chunk: bytes) -> tuple[int, int]:
    return DIGEST.unpack(xxhash.xxh3_128_digest(chunk))


CHUNK = "k1 long, k2 long, doc_id long, r1 long, r2 long, start int, stop int, lines int"


def _chunks(batches, min_lines: int, mean: int, digest):
    """The chunks of every text with their digests."""
    cols = [c.split()[0] for c in CHUNK.split(", ")]
    out: dict[str, list] = {c: [] for c in cols}
    for batch in batches:
        for doc_id, r1, r2, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "r1", "r2", "body")), strict=True):
            for a, b, n in chunk_spans(body, mean=mean):
                if n < min_lines or not (chunk := body[a:b].removesuffix(b"\n")).strip():
                    continue
                for c, v in zip(cols, (*digest(chunk), doc_id, r1, r2, a, b, n), strict=True):
                    out[c].append(v)
            if len(out["k1"]) > 1 << 14:
                yield out
                out = {c: [] for c in cols}
    if out["k1"]:
        yield out


def _bytes(batches):
    """The bytes of the chunks listed in ``spans``; equal rows of a batch are one."""
    for batch in batches:
        held, size = {}, 0
        for body, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            for s in spans:
                key = (s["k1"], s["k2"], body[s["start"] : s["stop"]].removesuffix(b"\n"))
                held[key] = held.get(key, 0) + 1
                size += len(key[2])
            if size > 8 << 20:
                yield dict(zip(("k1", "k2", "chunk", "n"), (*map(list, zip(*held, strict=True)), list(held.values())), strict=True))
                held, size = {}, 0
        if held:
            yield dict(zip(("k1", "k2", "chunk", "n"), (*map(list, zip(*held, strict=True)), list(held.values())), strict=True))


def _placed(batches):
    """As ``_bytes``, a row per place."""
    for batch in batches:
        for r1, r2, body, spans in zip(*(batch.column(c).to_pylist() for c in ("r1", "r2", "body", "spans")), strict=True):
            yield {
                "k1": [s["k1"] for s in spans], "k2": [s["k2"] for s in spans], "chunk": [body[s["start"] : s["stop"]].removesuffix(b"\n") for s in spans],
                "r1": [r1] * len(spans), "r2": [r2] * len(spans), "start": [s["start"] for s in spans],
            }


def repeated_chunks(base: DataFrame, min_lines: int = 2, mean: int = 4, digest=_digest) -> DataFrame:
    """base: of ``keyed``. (r1, r2, spans): the byte spans and lines of chunks to remove, first places left out."""
    chunks, _ = cut(map_arrow(base, lambda it: _chunks(it, min_lines, mean, digest), CHUNK), "chunks")
    counts = chunks.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    again, _ = cut(chunks.join(counts, ["k1", "k2"]), "chunks")
    spans = again.groupBy("r1", "r2").agg(F.collect_set(F.struct("k1", "k2", "start", "stop")).alias("spans"))
    texts = base.select("r1", "r2", "body").join(spans, ["r1", "r2"])
    # the bytes decide: a digest with one text is that text, others are told apart by their bytes
    each = map_arrow(texts, _bytes, "k1 long, k2 long, chunk binary, n long").groupBy("k1", "k2", "chunk").agg(F.sum("n").alias("n"))
    shared, _ = cut(each.groupBy("k1", "k2").agg(F.count("*").alias("texts")).where("texts > 1").drop("texts"), "shared")
    whole = again.withColumn("chunk", F.lit(None).cast("binary"))
    if shared.limit(1).count():
        placed = map_arrow(texts, _placed, "k1 long, k2 long, chunk binary, r1 long, r2 long, start int").join(shared, ["k1", "k2"]).distinct()
        whole = again.join(shared, ["k1", "k2"], "left_anti").withColumn("chunk", F.lit(None).cast("binary"))
        whole = whole.unionByName(again.join(placed, ["k1", "k2", "r1", "r2", "start"]))
    key = [F.col("k1"), F.col("k2"), F.coalesce("chunk", F.lit(b"")).alias("chunk")]
    whole = whole.withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2", "start"))
    firsts = whole.groupBy(*key).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = whole.withColumn("chunk", key[2]).join(firsts, ["k1", "k2", "chunk"]).where("place != first")
    return gone.groupBy("r1", "r2").agg(F.collect_set(F.struct("start", "stop", "lines")).alias("spans"))


def _rest(body: bytes, spans: list[dict]) -> bytes:
    parts, end = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        parts.append(body[end : s["start"]])
        end = s["stop"]
    return b"".join([*parts, body[end:]])


def _windows(batches, min_lines: int):
    """The place of every ``min_lines`` consecutive lines that hold a word, with a digest of their bytes."""
    cols = ("doc_id", "r1", "r2", "line", "start", "stop", "k1", "k2")
    out: dict[str, list] = {c: [] for c in cols}
    for batch in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
        for doc_id, r1, r2, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "r1", "r2", "body")), strict=True):
            lines = _lines(body)
            ends = [0, *accumulate(map(len, lines))]
            for i in range(len(lines) - min_lines + 1):
                a, b = ends[i], ends[i + min_lines]
                if not (window := body[a:b].removesuffix(b"\n")).strip():
                    continue
                k1, k2 = DIGEST.unpack(hashlib.blake2b(window, digest_size=16).digest())
                for c, v in zip(cols, (doc_id, r1, r2, i, a, b, k1, k2), strict=True):
                    out[c].append(v)
            if len(out["line"]) > 1 << 13:
                yield out
                out = {c: [] for c in cols}
    if out["line"]:
        yield out


def _runs(batches, min_lines: int):
    """Windows that overlap or touch become one span."""
    for batch in batches:
        spans = []
        for windows in batch.column("windows").to_pylist():
            runs = []
            for w in sorted(windows, key=lambda w: w["line"]):
                if runs and w["line"] <= runs[-1]["first"] + runs[-1]["lines"]:
                    runs[-1] |= {"stop": w["stop"], "lines": w["line"] + min_lines - runs[-1]["first"]}
                else:
                    runs.append({"first": w["line"], "start": w["start"], "stop": w["stop"], "lines": min_lines})
            spans.append([{k: r[k] for k in ("start", "stop", "lines")} for r in runs])
        yield {"r1": batch.column("r1"), "r2": batch.column("r2"), "spans": spans}


def repeated_lines(base: DataFrame, min_lines: int = 2) -> DataFrame:
    """base: of ``keyed``. (r1, r2, spans) as ``repeated_chunks``, of all lines in a run of ``min_lines`` or more that stands in
    an earlier place too. No boundaries are drawn: every window of lines is looked up. The first place of a line is never in
    such a run, so no line leaves the corpus."""
    windows = map_arrow(base, lambda it: _windows(it, min_lines), "doc_id long, r1 long, r2 long, line int, start int, stop int, k1 long, k2 long")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2", "line")
    firsts = windows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(place).alias("f")).where("n > 1").select("k1", "k2", "f")
    later = windows.join(firsts, ["k1", "k2"]).where(~place.eqNullSafe(F.col("f")))
    held = later.groupBy("r1", "r2").agg(F.collect_set(F.struct("line", "start", "stop")).alias("windows"))
    return map_arrow(held, lambda it: _runs(it, min_lines), "r1 long, r2 long, spans array<struct<start int, stop int, lines int>>")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2) -> DataFrame:
    """``docs`` with the repeated runs of lines taken out of ``text_col``; all columns and rows stay."""
    a, b, spans = free_names(docs, "r1", "r2", "spans")
    marks = repeated_lines(keyed(docs, id_col, text_col), min_lines).select(F.col("r1").alias(a), F.col("r2").alias(b), F.col("spans").alias(spans))
    r1, r2 = row_key(F.col(id_col), F.col(text_col))
    joined = docs.withColumns({a: r1, b: r2}).join(marks, [a, b], "left").select(*docs.columns, spans)
    at, n = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for batch in batches:
            new = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist(), strict=True):
                new.append(text if not spans else _rest(text.encode(), spans).decode())
            cols = [pa.array(new, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([batch.schema.field(i) for i in range(n)]))

    small_batches(joined.sparkSession)
    return joined.mapInArrow(handing_back(run), docs.schema)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, mean: int = 4) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, n_removed_chunks and the SHA-256 of the remaining text, a row per row."""
    base = keyed(docs, id_col, text_col)
    return _report(base, repeated_chunks(base, min_lines, mean))


def line_run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2) -> DataFrame:
    """As ``line_report``, of ``repeated_lines``; n_removed_chunks counts the runs taken out."""
    base = keyed(docs, id_col, text_col)
    return _report(base, repeated_lines(base, min_lines))


def _report(base: DataFrame, marks: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            yield {
                "r1": batch.column("r1"), "r2": batch.column("r2"),
                "n_removed_lines": [sum(s["lines"] for s in x) for x in spans], "n_removed_chunks": [len(x) for x in spans],
                "kept": [hashlib.sha256(_rest(b, x)).hexdigest() for b, x in zip(batch.column("body").to_pylist(), spans, strict=True)],
            }

    changed = map_arrow(base.join(marks, ["r1", "r2"]), run, "r1 long, r2 long, n_removed_lines long, n_removed_chunks long, kept string").dropDuplicates(["r1", "r2"])
    body = F.col("body").cast("string")
    n_lines = F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"), F.lit(""))) + F.when((F.octet_length(body) > 0) & ~body.endswith("\n"), 1).otherwise(0)
    own = base.select("doc_id", "r1", "r2", n_lines.cast("long").alias("n_lines"), F.sha2("body", 256).alias("own"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return own.join(changed, ["r1", "r2"], "left").select("doc_id", "n_lines", zero("n_removed_lines"), zero("n_removed_chunks"), F.coalesce("kept", "own").alias("kept_sha256"))
