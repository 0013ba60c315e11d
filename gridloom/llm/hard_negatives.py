"""Hard-negative mining with an orthogonal PCA rotation.

Scores are integer inner products of quantised vectors. All vectors are turned by the right vectors of the table's PCA, which
changes no inner product but puts most of a vector into its first entries. Block by block the products of the leading entries
are accumulated; what the rest can add is bounded by the product of the remainders' norms plus slack for rounding. A pair whose
bound is below what its anchor needs (the worst of those it has) is dropped early; what is left is scored in integers.

Anchors meet all rows in cells, ``ANCHORS`` anchors by ``ROWS`` rows at most, dealt by hash: a cell is one task's, whatever its
label or vector, and gives the best few of its rows for each anchor; these are ranked by anchor. No pair is written that isn't
among a cell's best.

Rows with a null label, a null vector or a null or non-finite entry take no part, nor do vectors of another length than most
rows have. A row without id is no anchor; as positive or negative it comes after others of its score. Repeated rows are rows of
their own: a copy of an anchor is another row of its label. An anchor without positives, or a positive without negatives, gives
no row; so does an empty table. Columns other than the id, label and vector aren't read. Products that don't fit a long raise
an OverflowError. No texts are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.llm.common import cut, hand_back, lean
from gridloom.llm.whitening import Whitening, finite, fit, matrix, quantised, usual_length

#: Anchors and rows of a cell, on average, at most.
ANCHORS, ROWS = 1024, 4096
#: Rows that are multiplied at once at most, beginning with FIRST.
CHUNK, FIRST = 2048, 64
#: Share of a chunk's pairs below which the pairs left are scored one by one.
SPARSE = 0.02


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of both, exact: in doubles where no sum can reach 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most >= 2**63:
        raise OverflowError("inner products don't fit a long")
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**53 else a @ b.T


class Turned:
    """Integer rows, their turned form, and the norms of what follows each stage's entries."""

    def __init__(self, x: np.ndarray, q: np.ndarray):
        d = x.shape[1]
        self.x, self.y = x, x.astype(float) @ q.T
        self.stages = sorted({max(1, d * i // 4) for i in (1, 2, 3)} | {d})
        squares = np.cumsum((self.y**2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = [np.sqrt(squares[:, m]) if m < d else np.zeros(len(x)) for m in self.stages]
        self.norm = np.sqrt((self.y**2).sum(1))


def survivors(a: Turned, b: Turned, lo: int, hi: int, need: np.ndarray, cap: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs of all anchors and rows lo..hi with need <= score <= cap that are allowed."""
    slack = 16 * (a.x.shape[1] + 16) * np.finfo(float).eps * np.outer(a.norm, b.norm[lo:hi]) + 1e-9
    part, done, alive = np.zeros((len(a.x), hi - lo)), 0, allowed
    for m, rest_a, rest_b in zip(a.stages, a.rest, b.rest, strict=True):
        part += a.y[:, done:m] @ b.y[lo:hi, done:m].T
        room = np.outer(rest_a, rest_b[lo:hi]) + slack
        alive = alive & (part + room >= need[:, None]) & (part - room <= cap[:, None])
        done = m
        if np.count_nonzero(alive) <= SPARSE * alive.size:
            break
    i, j = np.nonzero(alive)
    if len(i) <= SPARSE * alive.size:
        score = np.empty(len(i), np.int64)
        for s in range(0, len(i), 8192):
            at = slice(s, s + 8192)
            score[at] = np.einsum("ij,ij->i", a.x[i[at]], b.x[lo + j[at]])
    else:
        score = products(a.x, b.x[lo:hi])[i, j]
    good = (score >= need[i]) & (score <= cap[i])
    return i[good], lo + j[good], score[good]


def best(a: Turned, b: Turned, of: np.ndarray, floor: np.ndarray, cap: np.ndarray, k: int, allowed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, row, score): for each entry, whose anchor is ``of``, the k best rows with floor <= score <= cap; earlier rows win ties.

    ``allowed(lo, hi)`` tells which pairs of anchors and rows count. Products that could overflow are refused by their bound.
    """
    if a.x.size and b.x.size and float(np.abs(a.x).max()) * float(np.abs(b.x).max()) * a.x.shape[1] >= 2**63:
        raise OverflowError("inner products don't fit a long")
    order = np.argsort(of, kind="stable")
    first = np.searchsorted(of[order], np.arange(len(a.x) + 1))
    least = floor.copy()
    e = r = s = np.empty(0, np.int64)
    lo, step, big = 0, FIRST, np.iinfo(np.int64).max
    while lo < len(b.x):
        hi = min(len(b.x), lo + step)
        need, top = np.full(len(a.x), big), np.full(len(a.x), -big)
        np.minimum.at(need, of, least)
        np.maximum.at(top, of, cap)
        i, j, score = survivors(a, b, lo, hi, need, top, allowed(lo, hi))
        count = first[i + 1] - first[i]
        each = np.repeat(np.arange(len(i)), count)
        within = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        entry = order[first[i[each]] + within]
        good = (score[each] >= least[entry]) & (score[each] <= cap[entry])
        e, r, s = np.concatenate([e, entry[good]]), np.concatenate([r, j[each][good]]), np.concatenate([s, score[each][good]])
        by = np.lexsort((r, -s, e))
        e, r, s = e[by], r[by], s[by]
        place = np.arange(len(e)) - np.searchsorted(e, e)
        keep = place < k
        e, r, s, place = e[keep], r[keep], s[keep], place[keep]
        full = place == k - 1
        least[e[full]] = np.maximum(least[e[full]], s[full] + 1)  # rows come in the order of ties
        lo, step = hi, min(CHUNK, 2 * step)
    return e, r, s


def _spread(df: DataFrame, name: str, own: Column, other: str, copies: Column) -> DataFrame:
    """``df`` with its own number among ``name`` and a copy for each number of ``other``."""
    return df.withColumn(name, own).withColumn(other, F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))))


def _dealt(rows: DataFrame, anchors: DataFrame, keys: list[str], n_rows: str | int, n_anchors: str | int):
    """Both sides grouped by keys and cell; ``n_rows`` and ``n_anchors`` (numbers or columns of both) count those of the keys."""
    many = lambda n, size: F.ceil((F.col(n) if isinstance(n, str) else F.lit(n)) / size)
    down, across = many(n_rows, ROWS), many(n_anchors, ANCHORS)
    part = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "row"), n).cast("int")
    rows = rows.select(*(F.col(c).alias(c) for c in rows.columns))  # columns of their own: both sides may stem from one frame
    left = _spread(anchors, "g", part(1, across), "s", down).groupBy(*keys, "g", "s")
    right = _spread(rows, "s", part(2, down), "g", across).groupBy(*keys, "g", "s")
    return left.cogroup(right)


def _cells(fn):
    """``fn`` over tables of a cell's two sides, rows in the order of ids; memory goes back afterwards."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        try:
            place = [("vec_id", "ascending"), ("row", "ascending")]
            return fn(left.combine_chunks(), right.sort_by(place).combine_chunks())
        finally:
            hand_back()

    return run


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _vectors(t: pa.Table) -> np.ndarray:
    c = t.column("x")
    return matrix(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c)


POSITIVES = "anchor long, anchor_id long, positive long, positive_id long, positive_score long"
NEGATIVES = "anchor long, anchor_id long, place int, positive_id long, positive_score long, row long, negative_id long, negative_score long"


def prepared(df: DataFrame, vector: str, label: str, id_col: str, scale: int) -> DataFrame:
    """row (a number), vec_id, label, x (whole numbers): stored, so that numbers stay."""
    usable = df.where(finite(vector) & F.col(label).isNotNull())
    rows = usable.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), quantised(vector, scale).alias("x"))
    return cut(usual_length(rows, "x").withColumn("row", F.monotonically_increasing_id()), "vectors")[0]


def mine(
    df: DataFrame, anchor: Column, vector: str = "embedding", label: str = "label", id_col: str = "vec_id", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` (over vec_id) tells the anchors; a positive is one of the ``positives`` best other rows of an anchor's label; negatives
    are rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = df.sparkSession
    rows = prepared(df, vector, label, id_col, scale)
    nothing = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    got = fit(rows, "x")
    if got is None:
        return nothing
    q = Whitening.of(got, got.v.shape[1]).vectors
    chosen = rows.where(anchor)
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(anchor, 1)).alias("m")).where("m > 0")
    big = np.iinfo(np.int64).max

    @_cells
    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({f: pa.array([], pa.int64()) for f in ("anchor", "anchor_id", "positive", "positive_id", "positive_score")})
        a, b, mine_, theirs = Turned(_vectors(left), q), Turned(_vectors(right), q), _column(left, "row"), _column(right, "row")
        n = len(left)
        e, r, s = best(a, b, np.arange(n), np.full(n, -big), np.full(n, big), positives, lambda lo, hi: mine_[:, None] != theirs[None, lo:hi])
        return pa.table({"anchor": mine_[e], "anchor_id": left.column("vec_id").take(pa.array(e)), "positive": theirs[r], "positive_id": right.column("vec_id").take(pa.array(r)), "positive_score": s})

    both = lambda side: side.join(counts, "label")
    found = _dealt(both(rows), both(chosen), ["label"], "n", "m").applyInArrow(nearest, POSITIVES)
    top = W.partitionBy("anchor").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive")
    pairs = found.withColumn("place", F.row_number().over(top)).where(F.col("place") <= positives)
    each = pairs.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    seekers, _ = cut(chosen.join(each, F.col("row") == F.col("anchor")).drop("anchor"), "seekers")
    total, sought = rows.count(), seekers.count()
    if not sought:
        return nothing

    @_cells
    def beyond(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor", "anchor_id", "place", "positive_id", "positive_score", "row", "negative_id", "negative_score"]
        if not len(left) or not len(right):
            return pa.table({f: pa.array([], pa.int32() if f == "place" else pa.int64()) for f in names})
        a, b = Turned(_vectors(left), q), Turned(_vectors(right), q)
        p = left.column("p").combine_chunks()
        size = p.value_lengths().to_numpy()
        flat = p.flatten()
        of, score = np.repeat(np.arange(len(left)), size), flat.field("positive_score").to_numpy()
        floor, cap = -(-low * score // 100), high * score // 100
        here, there = _column(left, "label"), _column(right, "label")
        e, r, s = best(a, b, of, floor, cap, negatives, lambda lo, hi: here[:, None] != there[None, lo:hi])
        at, who = pa.array(e), pa.array(of[e])
        took = [left.column("row").take(who), left.column("vec_id").take(who), flat.field("place").take(at), flat.field("positive_id").take(at), flat.field("positive_score").take(at)]
        return pa.table(dict(zip(names, [*took, right.column("row").take(pa.array(r)), right.column("vec_id").take(pa.array(r)), pa.array(s)], strict=True)))

    slim = seekers.select("row", "vec_id", "label", "x", "p")
    met = _dealt(rows, slim, [], total, sought).applyInArrow(beyond, NEGATIVES)
    order = W.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "row")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

