"""Surfaces over cells: components, exact distances, kernels, resampling, projections, rasterising."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.functions import columns as C
from gridloom.operators import grid as G
from gridloom.sources.files import stored

FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def connected_components(mask: DataFrame, offsets: list[tuple[int, int]] = FOUR) -> DataFrame:
    """mask: the cells (r, c). (r, c, label), the label the least cell number of the component.

    Alternating stars over edges between neighbouring cells: rounds grow with the logarithm of a component's width.
    """
    number = (F.col("r").cast("long") * F.lit(1 << 31) + F.col("c")).alias("i")
    cells = stored(mask.select("r", "c", number), "cells")
    near = G.neighbours(cells.select("r", "c", "i"), offsets).select("r", "c", F.col("i").alias("j"))
    edges = cells.join(near, ["r", "c"]).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    edges, before = stored(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(low.select(F.col("m").alias("a"), "b"))
        edges = stored(small.where("a <> b").distinct(), "edges")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    label = edges.groupBy(F.col("b").alias("i")).agg(F.min("a").alias("label"))
    return cells.join(label, "i", "left").select("r", "c", F.coalesce("label", "i").alias("label"))


def conditioned_mask(cells: DataFrame, steps: int = 3, share: float = 0.01) -> DataFrame:
    """cells: r, c, tag (0 or null: bad). (r, c, outlier): bad cells and all within ``steps`` four-neighbour steps of one, then the
    components of the rest that have under ``share`` of the largest one's cells."""
    bad = cells.where(F.coalesce(F.col("tag"), F.lit(0)) == 0).select("r", "c")
    diamond = [(i, j) for i in range(-steps, steps + 1) for j in range(-steps, steps + 1) if abs(i) + abs(j) <= steps]
    grown = G.neighbours(bad, diamond).select("r", "c").distinct()
    parts = stored(connected_components(cells.select("r", "c").join(grown, ["r", "c"], "left_anti")), "parts")
    size = parts.groupBy("label").agg(F.count("*").alias("size"))
    large = size.join(F.broadcast(size.agg((F.max("size") * share).alias("least")))).where("size >= least").select("label")  # one row
    kept = parts.join(large, "label", "left_semi").select("r", "c", F.lit(False).alias("outlier"))
    return cells.select("r", "c").join(kept, ["r", "c"], "left").select("r", "c", F.coalesce("outlier", F.lit(True)).alias("outlier"))


def _envelope(rows: np.ndarray, gap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """min over k of (at - rows[k])^2 + gap[k], by the lower envelope of the parabolas; rows ascend."""
    keep, edge = [0], [-math.inf]
    for k in range(1, len(rows)):
        while True:
            j = keep[-1]
            x = (gap[k] + rows[k] ** 2 - gap[j] - rows[j] ** 2) / (2 * (rows[k] - rows[j]))
            if x > edge[-1] or len(keep) == 1:
                break
            keep.pop()
            edge.pop()
        keep.append(k)
        edge.append(x)
    best = np.array(keep)[np.searchsorted(edge[1:], at, side="left")]
    return (at - rows[best]) ** 2 + gap[best]


def distance_transform(cells: DataFrame, feature: Column) -> DataFrame:
    """(r, c, d): the exact Euclidean distance to the nearest feature cell, null where there is none.

    Along rows by two running aggregates, then down columns by the envelope of parabolas: a task holds one column.
    """
    row = W.partitionBy("r")
    mark = F.when(feature, F.col("c"))
    left, right = F.max(mark).over(row.orderBy("c")), F.min(mark).over(row.orderBy(F.desc("c")))
    gap = F.least(F.col("c") - left, right - F.col("c"))
    flat = cells.select("r", "c", (gap * gap).cast("double").alias("g"))

    def down(column: pd.DataFrame) -> pd.DataFrame:
        column = column.sort_values("r")
        known = column[column.g.notna()]
        d = np.sqrt(_envelope(known.r.to_numpy(float), known.g.to_numpy(), column.r.to_numpy(float))) if len(known) else None
        return pd.DataFrame({"r": column.r, "c": column.c, "d": d})

    return flat.groupBy("c").applyInPandas(down, "r int, c int, d double")


#: Fixed value: how far the filling library searches, in cells.
SEARCH = 100


def inverse_distance_fill(cells: DataFrame, value: str, search: int = SEARCH) -> DataFrame:
    """cells: all cells of a grid (r, c, value). (r, c, z): a missing value from the nearest known cell of each quadrant within ``search``,
    weighted by the inverse of the distance; null where none is. A quadrant holds one of its two axes.

    The nearest known cells of every row to the left and right come from running aggregates; then a task goes down one column.
    """
    row = W.partitionBy("r").orderBy("c")
    known = F.when(F.col(value).isNotNull(), F.struct("c", F.col(value).cast("double").alias("z")))
    sides = {
        "ls": F.last(known, ignorenulls=True).over(row.rowsBetween(W.unboundedPreceding, -1)), "li": F.last(known, ignorenulls=True).over(row.rowsBetween(W.unboundedPreceding, 0)),
        "rs": F.first(known, ignorenulls=True).over(row.rowsBetween(1, W.unboundedFollowing)), "ri": F.first(known, ignorenulls=True).over(row.rowsBetween(0, W.unboundedFollowing)),
    }
    flat = cells.select("r", "c", F.col(value).cast("double").alias("z"), *(c.alias(n) for n, c in sides.items()))
    flat = flat.select("r", "c", "z", *(x for n in sides for x in (F.abs(F.col("c") - F.col(f"{n}.c")).cast("double").alias(f"{n}_g"), F.col(f"{n}.z").alias(f"{n}_z"))))

    def down(column: pd.DataFrame) -> pd.DataFrame:
        column = column.sort_values("r")
        r0, n = int(column.r.iloc[0]), int(column.r.iloc[-1] - column.r.iloc[0]) + 1
        at = column.r.to_numpy() - r0
        gap, val = {}, {}
        for side in ("ls", "li", "rs", "ri"):
            gap[side], val[side] = np.full(n, np.inf), np.full(n, np.nan)
            gap[side][at] = column[f"{side}_g"].fillna(np.inf).to_numpy()
            val[side][at] = column[f"{side}_z"].to_numpy()
        z = column.z.to_numpy(float).copy()
        miss = at[np.isnan(z)]
        total, weight = np.zeros(len(miss)), np.zeros(len(miss))
        # above with the left, above, below with the right, below: each offset is in one of them
        for side, sign, first in (("ls", -1, 0), ("ri", -1, 1), ("rs", 1, 0), ("li", 1, 1)):
            near, found = np.full(len(miss), search * search + 0.5), np.full(len(miss), np.nan)
            for dr in range(first, search + 1):
                row_ = miss + sign * dr
                inside = (row_ >= 0) & (row_ < n)
                if not inside.any():
                    break
                d = np.full(len(miss), np.inf)
                d[inside] = gap[side][row_[inside]] ** 2 + dr * dr
                closer = d < near
                near[closer], found[closer] = d[closer], val[side][row_[closer]]
            have = ~np.isnan(found)
            total[have] += found[have] / np.sqrt(near[have])
            weight[have] += 1 / np.sqrt(near[have])
        z[np.isnan(z)] = np.where(weight > 0, total / np.where(weight > 0, weight, 1), np.nan)
        return pd.DataFrame({"r": column.r, "c": column.c, "z": pd.Series(z, index=column.index).astype(object).where(~np.isnan(z), None)})

    return flat.groupBy("c").applyInPandas(down, "r int, c int, z double")


def bilinear(points: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """points: pid, x, y in pixels (a cell's centre is at +0.5). ``z`` from the four cells around; null if one is missing."""
    u, v = F.col("x") - 0.5, F.col("y") - 0.5
    at = points.select("pid", F.floor(u).cast("int").alias("c0"), F.floor(v).cast("int").alias("r0"), (u - F.floor(u)).alias("fx"), (v - F.floor(v)).alias("fy"))
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in (0, 1) for j in (0, 1))))
    four = at.withColumn("o", corner).select("pid", (F.col("r0") + F.col("o.dr")).alias("r"), (F.col("c0") + F.col("o.dc")).alias("c"), "fx", "fy", "o.dr", "o.dc")
    weight = F.when(F.col("dc") == 1, F.col("fx")).otherwise(1 - F.col("fx")) * F.when(F.col("dr") == 1, F.col("fy")).otherwise(1 - F.col("fy"))
    seen = four.join(cells.select("r", "c", F.col(value).alias("v")), ["r", "c"])
    got = seen.groupBy("pid").agg(F.sum(weight * F.col("v")).alias("z"), F.count("v").alias("n"))
    return points.select("pid").join(got, "pid", "left").select("pid", F.when(F.col("n") == 4, F.col("z")).alias("z"))


#: Fixed values of WGS 84 and the transverse Mercator zones: half axis, flattening, scale, false easting.
AXIS, FLAT, SCALE, EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def series_terms() -> tuple[float, float, list[float]]:
    """(rectifying radius, third flattening's ratio, three coefficients) of the transverse Mercator series."""
    n = FLAT / (2 - FLAT)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    return radius, 2 * math.sqrt(n) / (1 + n), [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]


def utm_text(lon: str, lat: str, meridian: float) -> tuple[str, str]:
    """Easting and northing as expressions that both dialects read, by a series of three terms (to about a millimetre)."""
    radius, k, terms = series_terms()
    dec = lambda x: f"cast({x!r} as double)"
    s = f"sin(radians({lat}))"
    t = f"sinh(atanh({s}) - {dec(k)} * atanh({dec(k)} * {s}))"
    turn = f"radians({lon} - {dec(meridian)})"
    xi, eta = f"atan2({t}, cos({turn}))", f"atanh(sin({turn}) / sqrt(1 + {t} * {t}))"
    more_e = " + ".join(f"{dec(a)} * cos({2 * (j + 1)} * {xi}) * sinh({2 * (j + 1)} * {eta})" for j, a in enumerate(terms))
    more_n = " + ".join(f"{dec(a)} * sin({2 * (j + 1)} * {xi}) * cosh({2 * (j + 1)} * {eta})" for j, a in enumerate(terms))
    scale = dec(SCALE * radius)
    return f"{dec(EAST)} + {scale} * ({eta} + {more_e})", f"{scale} * ({xi} + {more_n})"


def polar_text(lon: str, lat: str, meridian: float = -45.0, true_lat: float = 70.0) -> tuple[str, str]:
    """Polar stereographic x and y as expressions that both dialects read."""
    e = math.sqrt(FLAT * (2 - FLAT))
    true = math.radians(true_lat)
    tight = lambda a: math.tan(math.pi / 4 - a / 2) / ((1 - e * math.sin(a)) / (1 + e * math.sin(a))) ** (e / 2)
    scale = AXIS * math.cos(true) / math.sqrt(1 - (e * math.sin(true)) ** 2) / tight(true)
    dec = lambda x: f"cast({x!r} as double)"
    a = f"radians({lat})"
    rho = f"{dec(scale)} * tan({dec(math.pi / 4)} - {a} / 2) / power((1 - {dec(e)} * sin({a})) / (1 + {dec(e)} * sin({a})), {dec(e / 2)})"
    turn = f"radians({lon} - {dec(meridian)})"
    return f"{rho} * sin({turn})", f"-1 * {rho} * cos({turn})"


def quadric(cells: DataFrame, value: str, size: float) -> DataFrame:
    """Slope, planform and profile curvature from the surface through a cell's nine values; null at the rim."""
    names = {f"z{3 * (i + 1) + j + 2}": (i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)}
    x = G.stencil(cells, value, names)
    z = {k: F.col(f"z{k}") for k in range(1, 10)}
    d, e = ((z[4] + z[6]) / 2 - z[5]) / size**2, ((z[2] + z[8]) / 2 - z[5]) / size**2
    f = (z[3] + z[7] - z[1] - z[9]) / (4 * size**2)
    g, h = (z[6] - z[4]) / (2 * size), (z[2] - z[8]) / (2 * size)
    x = x.select("r", "c", d.alias("d"), e.alias("e"), f.alias("f"), g.alias("g"), h.alias("h"))
    g, h, s = F.col("g"), F.col("h"), F.col("g") * F.col("g") + F.col("h") * F.col("h")
    profile = -2 * (F.col("d") * g * g + F.col("e") * h * h + F.col("f") * g * h)
    planform = 2 * (F.col("d") * h * h + F.col("e") * g * g - F.col("f") * g * h)
    by = lambda c: F.when(s > 0, F.try_divide(c, s)).when(s == 0, 0.0)
    return x.select("r", "c", F.sqrt(s).alias("slope"), by(planform).alias("planform"), by(profile).alias("profile"))


def in_polygon(cells: DataFrame, rings: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """``name``: the first polygon that holds a cell's centre, null if none; polygons are a map in the plan (few, by their vertices)."""
    x, y = F.col("c") + 0.5, F.col("r") + 0.5
    name = F.lit(None).cast("string")
    for key, ring in reversed(list(rings.items())):
        vertices = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ring))
        name = F.when(C.in_ring(x, y, vertices), F.lit(key)).otherwise(name)
    return cells.withColumn("name", name)
