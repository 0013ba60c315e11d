"""Embedding whitening by hierarchical SVD merging.

Every task folds its rows, block by block, into one summary: their number, exact sums, mean, and the singular values and right
vectors of the centred rows, at full rank. Two summaries merge by stacking both sets of scaled vectors and one more row, the
difference of the means times sqrt(n1 n2 / (n1 + n2)), and taking the SVD again; nothing is cut off, so the result is that of
all rows at once, up to rounding. Summaries merge ``FAN`` at a time in a tree; only the last one, d x d numbers for vectors of d
entries, reaches the driver, and it is handed to all tasks.

Vectors are arrays of whole numbers (``quantised`` makes them); sums and deviations are exact. Rows whose vector is null or holds
a null or non-finite entry are left out; so are vectors of another length than most rows have (the longer of two as common).
Null or repeated ids and equal rows are carried as they are; an empty table gives no rows. A component without variance (fewer
distinct vectors than entries) is whitened to null. Numbers that don't fit a long raise an overflow error (Spark's or Python's). Other columns aren't
touched; names that clash are avoided. Vectors have no texts, so long texts play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, free_names, handing_back, small_batches

#: Summaries merged in one step of the tree.
FAN = 32
#: Rows of a block whose SVD is taken at once.
BLOCK = 4096
SUMMARY = "part long, n long, origin array<long>, sums array<long>, mean array<double>, s array<double>, v array<double>"


def finite(vector: str) -> Column:
    """Whether the array is there and all its entries are finite numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & good, F.lit(False))


def quantised(vector: str, scale: int, offset: int = 0) -> Column:
    """floor(scale * x) + offset of every entry, as longs."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")) + offset)


def usual_length(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose array is as long as most arrays are."""
    most = df.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return df.where(F.size(vector) == most.d) if most else df


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column as a matrix; lists are of one length and hold no nulls."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1 if len(column) else 0)


@dataclass(frozen=True)
class Summary:
    """n rows: exact sums; the mean, counted from ``origin``; singular values ``s`` and right vectors ``v`` (rows) of the centred rows."""

    n: int
    origin: np.ndarray
    sums: np.ndarray
    mean: np.ndarray
    s: np.ndarray
    v: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Summary:
        """Of a block of integer (exact) or real rows; whole numbers are counted from the first row, so that a far origin costs no digits."""
        origin = x[0].copy() if x.dtype.kind == "i" else np.zeros(x.shape[1], np.int64)
        if x.dtype.kind == "i" and max(-int(x.min()), int(x.max())) >= 2**52:
            raise OverflowError("entries of vectors must be below 2^52")
        y = (x - origin).astype(float)
        mean = y.mean(0)
        s, v = np.linalg.svd(y - mean, full_matrices=False)[1:]
        return Summary(len(x), origin, exact_sum(x) if x.dtype.kind == "i" else np.zeros(x.shape[1], np.int64), mean, s, v)

    def merge(self, other: Summary) -> Summary:
        n = self.n + other.n
        there = other.mean + (other.origin - self.origin)
        apart = np.sqrt(self.n * (other.n / n)) * (there - self.mean)
        s, v = np.linalg.svd(np.vstack([self.s[:, None] * self.v, other.s[:, None] * other.v, apart]), full_matrices=False)[1:]
        return Summary(n, self.origin, exact_sum(np.stack([self.sums, other.sums])), self.mean + (there - self.mean) * (other.n / n), s, v)

    def covariance(self) -> np.ndarray:
        return (self.v.T * (self.s**2 / self.n)) @ self.v

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "origin": self.origin, "sums": self.sums, "mean": self.mean, "s": self.s, "v": self.v.ravel()}

    @staticmethod
    def read(r) -> Summary:
        s = np.array(r.s, float)
        return Summary(int(r.n), np.array(r.origin, np.int64), np.array(r.sums, np.int64), np.array(r.mean, float), s, np.array(r.v, float).reshape(len(s), -1))


def exact_sum(x: np.ndarray) -> np.ndarray:
    if np.abs(x.astype(float)).sum(0).max(initial=0) >= 2**62:
        raise OverflowError("sums of vectors don't fit a long")
    return x.sum(0, dtype=np.int64)


def merged(summaries: list[Summary]) -> Summary:
    """Neighbours are merged pairwise until one is left."""
    while len(summaries) > 1:
        pairs = [summaries[i : i + 2] for i in range(0, len(summaries), 2)]
        summaries = [p[0].merge(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return summaries[0]


def fit(df: DataFrame, vector: str) -> Summary | None:
    """The summary of all rows' arrays (of one length, without nulls); None if there are no rows."""
    small_batches(df.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = None
        for batch in batches:
            x = matrix(batch.column(0))
            for lo in range(0, len(x), BLOCK):
                more = Summary.of(x[lo : lo + BLOCK])
                got = more if got is None else got.merge(more)
        if got is not None:
            yield pa.RecordBatch.from_pylist([got.row(TaskContext.get().partitionId())], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = df.sparkSession.createDataFrame([], SUMMARY).schema
    target = to_arrow_schema(kind)
    parts, _ = cut(df.select(vector).mapInArrow(handing_back(fold), kind), "summaries")
    last = parts.agg(F.max("part")).first()[0]
    if last is None:
        return None

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        return pd.DataFrame([merged([Summary.read(r) for r in rows.itertuples(index=False)]).row(int(rows.part.iloc[0]) // FAN)])

    while last > 0:
        parts = parts.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(join, SUMMARY)
        last //= FAN
    return merged([Summary.read(r) for r in parts.collect()])  # one row


@dataclass(frozen=True)
class Whitening:
    """``vectors`` (a row per component) over sqrt of ``values`` (falling), ``share`` of the trace; ``rank`` components have variance."""

    summary: Summary
    vectors: np.ndarray
    values: np.ndarray
    share: np.ndarray
    rank: int

    @staticmethod
    def of(summary: Summary, components: int) -> Whitening:
        d = summary.v.shape[1]
        q = np.linalg.qr(np.concatenate([summary.v.T, np.eye(d)], axis=1))[0].T  # completed to all d dimensions
        q[: len(summary.s)] = summary.v
        s = np.zeros(d)
        s[: len(summary.s)] = summary.s
        rank = int((s > max(summary.n, d) * np.finfo(float).eps * s[0]).sum()) if s.any() else 0
        e = s**2 / summary.n
        k = min(d, components)
        return Whitening(summary, q[:k], e[:k], e[:k] / e.sum() if rank else np.full(k, np.nan), min(rank, k))

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(deviations, whitened rows without components that have no variance)."""
        m, r = self.summary, self.rank
        y = (x - m.origin).astype(float) - m.mean
        n, total = m.n, m.sums - m.n * m.origin
        if len(x) and ((n * y) ** 2).sum(1).max() >= 2**62:
            raise OverflowError("squared deviations don't fit a long")
        off = n * (x - m.origin) - total
        return (off * off).sum(1), y @ (self.vectors[:r] / np.sqrt(self.values[:r, None])).T


def whiten(df: DataFrame, vector: str, model: Whitening, deviation: str = "deviation", whitened: str = "whitened") -> DataFrame:
    """``df`` with ``deviation`` (sum over entries of (n x - sum)^2) and ``whitened``, an array of the components' values."""
    small_batches(df.sparkSession)
    at = df.columns.index(vector)
    k, r = len(model.vectors), model.rank

    def run(batches):
        for batch in batches:
            off, w = model.apply(matrix(batch.column(at)))
            full = np.zeros((len(w), k))
            full[:, :r] = w
            gone = np.zeros((len(w), k), bool)
            gone[:, r:] = True
            values = pa.array(full.ravel(), mask=gone.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(off), lists], [*batch.schema.names, deviation, whitened])

    kind = df.withColumns({deviation: F.lit(0).cast("long"), whitened: F.array(F.lit(None).cast("double"))}).schema
    return df.mapInArrow(handing_back(run), kind)


def identity_error(df: DataFrame, whitened: str, rank: int) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    if not rank:
        return None
    got = fit(df.select(F.slice(whitened, 1, rank).alias("w")), "w")
    return float(np.abs(got.covariance() - np.eye(rank)).max())


def whiten_embeddings(df: DataFrame, vector: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """The rows of ``df`` with a usable vector, all columns, and ``n``, ``deviation``, ``whitened``, ``explained`` (arrays by component)
    and ``identity_error``; further columns of these names are replaced."""
    df = df.drop("n", "deviation", "whitened", "explained", "identity_error")
    (x,) = free_names(df, "x")
    rows = usual_length(df.where(finite(vector)).withColumn(x, quantised(vector, scale, offset)), x)
    got = fit(rows, x)
    if got is None:
        return rows.limit(0).drop(x).selectExpr("*", "0L as n", "0L as deviation", "array(0D) as whitened", "array(0D) as explained", "0D as identity_error")
    model = Whitening.of(got, components)
    out = whiten(rows, x, model)
    error = identity_error(whiten(rows.select(x), x, model), "whitened", model.rank)
    share = F.array(*(F.lit(None if math.isnan(s) else float(s)).cast("double") for s in model.share))
    return out.select(*df.columns, F.lit(got.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
