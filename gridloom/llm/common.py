"""Helpers shared by the corpus operators: the shared folder, row keys, Arrow plumbing, rolling windows."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    LIBC = None

#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
#: Bytes from which a worker's arrays are mapped by themselves.
LARGE = 1 << 20
#: Names of settings in the C library.
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD = -1, -3
#: A fixed value that tells the second half of a row's key from the first.
SEED = 7_919
#: Text handed to one vectorised step; bounds a Python worker's memory whatever the batch.
SLAB = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent on a single machine (as in tests) a fresh folder is used and set; a cluster needs it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def row_key(id_: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a row's id and text; rows equal in both share them, null ids included."""
    text, id_ = F.coalesce(text, F.lit("")), id_.cast("long")
    return F.xxhash64(id_, text), F.xxhash64(F.lit(SEED), text, id_.isNull(), id_)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, r1, r2, body`` of every row; r1 and r2 are its key, ``body`` is the UTF-8 text (null: empty). Other columns
    are left out, so that none can clash with an operator's own names."""
    r1, r2 = row_key(F.col(id_col), F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), r1.alias("r1"), r2.alias("r2"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for further columns that no column of ``df`` has (whatever its case)."""
    held, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow whose function yields dicts of column lists or arrays in the order of ``schema``."""
    small_batches(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(out)

    def run(batches):
        lean()
        try:
            for cols in fn(batches):
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in target], schema=target)
        finally:
            hand_back()

    return df.mapInArrow(run, out)


def small_batches(spark: SparkSession) -> None:
    """Batches handed to Python workers hold BATCH_BYTES or one row at most, however long texts are.

    This lowers a setting of the caller's session, for good: queries are planned later, when their results are read.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < size_of(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def size_of(setting: str) -> int:
    """A setting in bytes; it may have a unit (64m, 4kb)."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def handing_back(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` of mapInArrow, after which the worker's free memory goes back."""

    def run(batches):
        lean()
        try:
            yield from fn(batches)
        finally:
            hand_back()

    return run


def lean() -> None:
    """Arrays of ``LARGE`` bytes or more are mapped by themselves in this worker, so that they go back as soon as they are freed."""
    if LIBC and pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())
        LIBC.mallopt(M_MMAP_THRESHOLD, LARGE)
        LIBC.mallopt(M_TRIM_THRESHOLD, LARGE)


def hand_back() -> None:
    """Free memory goes back to the system, as the worker serves further tasks."""
    pa.default_memory_pool().release_unused()
    if LIBC:
        LIBC.malloc_trim(0)


def slabs(batch: pa.RecordBatch, name: str = "body", size: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, their bytes, each text's end in these) of stretches of about ``size`` bytes, a row at least."""
    body = batch.column(name)
    if not pa.types.is_binary(body.type):
        body = body.cast(pa.binary())
    _, offsets, values = body.buffers()
    at = np.frombuffer(offsets, np.int32, len(body) + 1, 4 * body.offset).astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(body):
        hi = min(len(body), max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1))
        yield lo, hi, data[at[lo] : at[hi]], at[lo + 1 : hi + 1] - at[lo]
        lo = hi


# --- rolling windows over 64-bit symbols ---------------------------------------------------------------

BASE = np.uint64(0x9E3779B97F4A7C15)
_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, b in (("p", BASE), ("i", inverse)):
            step = np.full(n, b, np.uint64)
            step[0] = 1
            _POW[name] = np.cumprod(step, dtype=np.uint64)
    return _POW["p"][:n], _POW["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and fold twice."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes mod 2^64 of every ``k`` consecutive symbols (already well mixed 64-bit values)."""
    n = len(symbols)
    if n < k:
        return np.empty(0, np.uint64)
    p, inv = powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * p, out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * inv[: n - k + 1])


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, by prefix and suffix minima of blocks of ``w``."""
    n = len(a) - w + 1
    if n <= 0:
        return a[:0]
    if w == 1:
        return a
    padded = np.full(-(-len(a) // w) * w, np.iinfo(a.dtype).max, a.dtype)
    padded[: len(a)] = a
    rows = padded.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


LOW = np.uint64(0xFFFFFF)


def super_windows(symbols: np.ndarray, ends: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows that share a minimiser.

    ``symbols`` holds several texts one after the other, ``ends`` their end offsets; at most 2^24 symbols. The
    minimiser of a window is its smallest k-gram, the rightmost of equals, so equal windows have equal minimisers.
    Returns per run: text number, minimiser's hash, its place, first and last window start (places in ``symbols``).
    """
    grams = gram_hashes(symbols, k)
    place = np.arange(len(grams), dtype=np.uint64)
    least = sliding_min((grams & ~LOW) | (LOW - (place & LOW)), window - k + 1)
    n = len(least)
    if not n:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none, none
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(n + 1, np.int8)
    long = ends - starts >= window
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - window + 1, -1)
    valid = np.cumsum(inside[:n]).astype(bool)
    at = (LOW - (least & LOW)).astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(valid & new)
    stop = np.ones(n, bool)
    stop[:-1] = new[1:] | ~valid[1:]
    last = np.flatnonzero(valid & stop)
    b = at[first]
    return np.searchsorted(ends, first, side="right"), grams[b], b, first, last
