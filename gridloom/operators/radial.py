"""Surfaces of a linear radial kernel through any number of points, by domain decomposition.

Up to ``LIMIT`` distinct places the system is one, solved in one task. Beyond, a coarse surface goes through the medians of at most
``COARSE`` x ``COARSE`` bins of the whole extent (a fixed number, whatever the points), and what is left is interpolated by tiles: each
tile solves for the points of itself and its eight neighbours, ``LIMIT`` at most, and the tiles' surfaces are blended by smooth
weights that sum to one where they overlap. Every tile's surface goes through all points of its overlap, so the whole goes
through all points. No task holds more than ``LIMIT`` points or about ``CELLS`` places to evaluate, and nothing but the coarse
surface (``COARSE`` squared + 1 numbers) or the one system's weights (``LIMIT`` + 1) passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.grid import checked_broadcast
from gridloom.sources.files import stored

#: Distinct places of one system at most.
LIMIT = 1_200
#: Bins of the coarse surface along an axis.
COARSE = 16
#: Places evaluated by one task at most, on average.
CELLS = 65_536
#: Part of a tile by which it reaches into its neighbours.
OVERLAP = 0.25


def solve(p: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Weights of the kernel -r at the distinct places p, and a constant last, so that the surface goes through v."""
    n = len(p)
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = -np.sqrt(((p[:, None] - p) ** 2).sum(-1))
    system[n, n] = 0
    return np.linalg.solve(system, np.append(v, 0.0)) if n > 1 else np.append(np.zeros(n), v.sum())


def value(p: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    z = np.empty(len(at))
    for lo in range(0, len(at), 2048):
        z[lo : lo + 2048] = -np.sqrt(((at[lo : lo + 2048, None] - p) ** 2).sum(-1)) @ w[:-1] + w[-1]
    return z


def _solved(points: DataFrame, **keys: Column) -> DataFrame:
    """A row per key with the places and weights of its system: arrays px, py, w."""
    names = list(keys)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["x", "y"])
        p = df[["x", "y"]].to_numpy(float)
        return pd.DataFrame({**{k: [df[k].iloc[0]] for k in names}, "px": [p[:, 0]], "py": [p[:, 1]], "w": [solve(p, df.v.to_numpy(float))]})

    types = "".join(f"{k} long, " for k in keys)
    return points.withColumns({k: c.cast("long") for k, c in keys.items()}).groupBy(*keys).applyInPandas(run, types + "px array<double>, py array<double>, w array<double>")


def _evaluated(df: DataFrame, name: str, weights: DataFrame) -> DataFrame:
    """``df`` (x, y) with the value of the one system in ``weights``."""
    r = stored(weights, "weights").first()
    p, w = np.column_stack([r.px, r.py]).reshape(-1, 2), np.array(r.w)

    def run(batches):
        for part in batches:
            yield part.assign(**{name: value(p, w, part[["x", "y"]].to_numpy(float))})

    return df.mapInPandas(run, df.withColumn(name, F.lit(0.0)).schema)


def _bins(x: str, lo: float, width: float, n: int) -> Column:
    return F.least(F.greatest(F.floor((F.col(x) - lo) / width), F.lit(0)), F.lit(n - 1))


def _tiles(x: str, lo: float, size: float, reach: float) -> Column:
    """All tile numbers along an axis that reach a place: a tile's own part and ``reach`` tiles on both sides."""
    u = (F.col(x) - lo) / size
    return F.sequence(F.floor(u - reach).cast("long"), F.floor(u + reach).cast("long"))


def radial_surface(points: DataFrame, at: DataFrame, limit: int = LIMIT) -> DataFrame:
    """points: x, y, v; places that repeat count with their mean. ``at`` (x, y and others) with ``z``; null without points."""
    places = stored(points.where("x is not null and y is not null and v is not null").groupBy("x", "y").agg(F.avg("v").alias("v")), "places")
    s = places.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    if not s.n:
        return at.withColumn("z", F.lit(None).cast("double"))
    if s.n <= limit:
        return _evaluated(at, "z", _solved(places, one=F.lit(0)).drop("one"))
    wide = max(s.x1 - s.x0, s.y1 - s.y0)
    # the coarse surface, and what it leaves
    step = wide / COARSE * (1 + 1e-9)
    coarse = places.groupBy(_bins("x", s.x0, step, COARSE), _bins("y", s.y0, step, COARSE)).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.median("v").alias("v"))
    weights = stored(_solved(coarse.select("x", "y", "v"), one=F.lit(0)).drop("one"), "coarse")
    rest = stored(_evaluated(places, "c", weights).select("x", "y", (F.col("v") - F.col("c")).alias("v")), "rest")
    size = _size(rest, s.x0, s.y0, wide, s.n, limit)
    near = rest.withColumn("tx", F.explode(_tiles("x", s.x0, size, 1.0))).withColumn("ty", F.explode(_tiles("y", s.y0, size, 1.0)))
    systems = stored(_solved(near, tx=F.col("tx"), ty=F.col("ty")), "systems")
    # each place is under one or two tiles along an axis, whose weights sum to one
    base = _evaluated(at, "_c", weights).withColumn("_id", F.monotonically_increasing_id())
    base = stored(base, "places")
    axis = lambda x, lo: F.transform(_tiles(x, lo, size, OVERLAP), lambda t: F.struct(t.alias("t"), _part((F.col(x) - lo) / size - t).alias("w")))
    each = base.select("_id", "x", "y", F.explode(axis("x", s.x0)).alias("a"), F.explode(axis("y", s.y0)).alias("b"))
    each = each.select("_id", "x", "y", F.col("a.t").alias("tx"), F.col("b.t").alias("ty"), (F.col("a.w") * F.col("b.w")).alias("k"))
    counts = stored(each.groupBy("tx", "ty").agg(F.ceil(F.count("*") / CELLS).alias("parts")), "tiles")
    dealt = each.join(checked_broadcast(counts), ["tx", "ty"]).withColumn("part", F.pmod(F.xxhash64("_id"), F.col("parts"))).drop("parts")
    there = systems.join(checked_broadcast(counts), ["tx", "ty"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def local(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"_id": pd.Series([], dtype="int64"), "d": pd.Series([], dtype="float64")})
        d = np.zeros(len(left))
        if len(right):
            r = right.iloc[0]
            d = left.k.to_numpy() * value(np.column_stack([r.px, r.py]), np.asarray(r.w, float), left[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"_id": left._id, "d": d})

    keys = ["tx", "ty", "part"]
    moved = dealt.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(local, "_id long, d double")
    total = moved.groupBy("_id").agg(F.sum("d").alias("_d"))
    return base.join(total, "_id").select(*at.columns, (F.col("_c") + F.col("_d")).alias("z"))


def _part(u: Column) -> Column:
    """A tile's weight at ``u`` tiles from its left edge: 1 inside, falling smoothly across the overlap at both edges."""

    def rise(t: Column) -> Column:
        s = F.least(F.greatest((t + OVERLAP) / (2 * OVERLAP), F.lit(0.0)), F.lit(1.0))
        return s * s * (3 - 2 * s)

    return rise(u) * (1 - rise(u - 1))


def _size(rest: DataFrame, x0: float, y0: float, wide: float, n: int, limit: int) -> float:
    """The largest of falling tile sizes at which no tile with its neighbours has more than ``limit`` points."""
    size = wide * np.sqrt(limit / (12.0 * n))
    while True:
        near = rest.select(F.explode(_tiles("x", x0, size, 1.0)).alias("tx"), "y").select("tx", F.explode(_tiles("y", y0, size, 1.0)).alias("ty"))
        most = near.groupBy("tx", "ty").count().agg(F.max("count")).first()[0]
        if most <= limit:
            return float(size)
        size *= max(0.5, 0.9 * np.sqrt(limit / most))
