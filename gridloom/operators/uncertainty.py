"""Error models: discs by running sums, bins with quantile edges in several variables, interpolation between bins, polygons as rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.quantiles import exact_nmad, exact_quantiles
from gridloom.sources.files import stored

#: Columns and rows of a block of cells; a task holds one, and a disc's reach around it.
STRETCH, ROWS = 4096, 64
#: The smallest count of a bin that counts, and the spread beyond which standardised values are outliers.
LEAST_COUNT, OUTLIER_SPREADS = 5, 7.0


def log_areas(least: float, most: float, n: int = 15) -> list[float]:
    """``n`` areas at equal steps of their logarithm."""
    return [least * (most / least) ** (i / (n - 1)) for i in range(n)]


def half_widths(area: float) -> list[int]:
    """Of a disc of this area (in cells) its greatest column offset by row offset 0, 1, ...: cells whose centres it holds."""
    square = area / math.pi
    return [math.isqrt(math.floor(square - d * d + 1e-9)) for d in range(math.isqrt(math.floor(square + 1e-9)) + 1)]


def disc_means(cells: DataFrame, value: str, areas: list[float], least: float = 0.8, stretch: int = STRETCH) -> DataFrame:
    """(area, r, c, mean) of the disc around every cell, for each area (in cells); where under ``least`` of a disc's cells have a value, none.

    Rows become running sums by blocks of ``ROWS`` rows and ``stretch`` columns, so a disc is the difference of two of them per row that it
    crosses: work grows with its height, not with its area. A block meets only the cells within the largest disc's reach.
    """
    discs = [half_widths(a) for a in areas]
    reach, height = max(len(d) for d in discs) - 1, ROWS
    have = cells.where(F.col(value).isNotNull()).select("r", "c", F.col(value).cast("double").alias("v"))
    near = lambda axis, size: F.explode(F.sequence(F.floor((F.col(axis) - reach) / size), F.floor((F.col(axis) + reach) / size)))
    spread = have.withColumn("at", near("r", height)).withColumn("k", near("c", stretch))
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be merged to few tasks

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        top, left = int(group["at"].iloc[0]) * height, int(group.k.iloc[0]) * stretch
        shape = (height + 2 * reach, stretch + 2 * reach + 1)
        total, count = np.zeros(shape), np.zeros(shape)
        place = group.r.to_numpy() - top + reach, group.c.to_numpy() - left + reach + 1
        total[place], count[place] = group.v.to_numpy(), 1
        r, c = np.nonzero(count[reach : reach + height, reach + 1 : reach + 1 + stretch])
        total, count = total.cumsum(1), count.cumsum(1)
        out = []
        for area, disc in zip(areas, discs, strict=True):
            s, n, size = np.zeros(len(r)), np.zeros(len(r)), 0
            for d in range(1 - len(disc), len(disc)):
                h = disc[abs(d)]
                at, a, b = r + d + reach, c + reach - h, c + reach + h + 1
                s += total[at, b] - total[at, a]
                n += count[at, b] - count[at, a]
                size += 2 * h + 1
            good = n >= least * size
            out.append(pd.DataFrame({"area": area, "r": r[good] + top, "c": c[good] + left, "mean": s[good] / n[good]}))
        return pd.concat(out)

    return spread.repartition(tasks, "at", "k").groupBy("at", "k").applyInPandas(sums, "area double, r int, c int, mean double")


def quantile_edges(df: DataFrame, columns: list[str], n: int = 10) -> dict[str, list[float]]:
    """Of each column the distinct quantiles at ``n`` equal steps from 0 to 1: ``n`` numbers per column at most."""
    probs = {f"q{i}": i / (n - 1) for i in range(n)}
    each = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("e")).select("e.*")
    found = {r["name"]: r for r in exact_quantiles(each, ["name"], "v", probs).collect()}  # a row per column
    return {c: sorted({found[c][q] for q in probs}) for c in columns}


def bin_of(column: str, edges: list[float]) -> Column:
    """The number (from 0) of the bin between two edges that holds a value, the last with its upper edge; null outside."""
    x, last = F.col(column), len(edges) - 2
    number = sum(((x >= e).cast("int") for e in edges[1:-1]), F.lit(0)) if last > 0 else F.lit(0)
    return F.when((x >= edges[0]) & (x <= edges[-1]), F.least(number, F.lit(max(last, 0))))


def binned_spread(df: DataFrame, value: str, edges: dict[str, list[float]]) -> DataFrame:
    """Count and NMAD in all combinations of the variables' bins: (b0, b1, ..., n, nmad), a null bin for a variable not in the combination."""
    names = [f"b{i}" for i in range(len(edges))]
    inside = df.select(F.col(value).alias("v"), *(bin_of(c, e).alias(b) for b, (c, e) in zip(names, edges.items(), strict=True))).dropna()
    inside = stored(inside, "binned")
    sets = [[bool(k >> i & 1) for i in range(len(names))] for k in range(1, 1 << len(names))]
    each = F.explode(F.array(*(F.array(*map(F.lit, s)) for s in sets)))
    g = inside.withColumn("s", each).select("v", *(F.when(F.col("s")[i], F.col(b)).alias(b) for i, b in enumerate(names)))
    return exact_nmad(g, names, "v").select(*names, "n", "nmad")


def filled_bins(spread: DataFrame, edges: dict[str, list[float]], least: int = LEAST_COUNT) -> DataFrame:
    """All bins of the full combination (b0, ..., nmad); one with under ``least`` values takes the nearest's (by bin numbers, the
    first of equals). Bins are as many as the edges make, whatever the data."""
    names = [f"b{i}" for i in range(len(edges))]
    full = spread.where(" AND ".join(f"{b} IS NOT NULL" for b in names)).where(F.col("n") >= least).select(*names, "nmad")
    every = full.sparkSession.range(1).select(F.lit(0).alias("one"))
    for b, e in zip(names, edges.values(), strict=True):
        every = every.withColumn(b, F.explode(F.sequence(F.lit(0), F.lit(max(len(e) - 2, 0)))))
    far = sum(((F.col(f"e.{b}") - F.col(f"f.{b}")) * (F.col(f"e.{b}") - F.col(f"f.{b}")) for b in names), F.lit(0))
    near = every.alias("e").join(F.broadcast(full.alias("f")), how="cross")  # bins by bins: both as many as the edges make
    nearest = near.groupBy(*(F.col(f"e.{b}") for b in names)).agg(F.min_by("f.nmad", F.struct(far, *(F.col(f"f.{b}") for b in names))).alias("nmad"))
    return nearest.select(*names, "nmad")


def interpolated(df: DataFrame, bins: DataFrame, edges: dict[str, list[float]], name: str) -> DataFrame:
    """``df`` with the n-linear interpolation between the middles of the bins around; beyond the outermost middles it is constant.

    One broadcast join per corner (bins are as many as the edges make): no shuffle of the cells.
    """
    at, total = df, F.lit(0.0)
    for i, (column, e) in enumerate(edges.items()):
        mids = [(a + b) / 2 for a, b in zip(e, e[1:], strict=False)] or [e[0]]
        x = F.col(column).cast("double")
        low = F.least(sum(((x >= m).cast("int") for m in mids[1:]), F.lit(0)), F.lit(max(len(mids) - 2, 0)))
        at = at.withColumn(f"_i{i}", low)
        left, right = (F.element_at(F.array(*map(F.lit, mids)), F.least(F.col(f"_i{i}") + k, F.lit(len(mids)))) for k in (1, 2))
        share = F.when(right > left, (x - left) / (right - left)).otherwise(0.0)
        at = at.withColumn(f"_f{i}", F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    d = len(edges)
    sizes = [max(len(e) - 1, 1) for e in edges.values()]
    for corner in range(1 << d):
        up = [corner >> i & 1 for i in range(d)]
        side = bins.select(*(F.col(f"b{i}").alias(f"_b{i}") for i in range(d)), F.col("nmad").alias(f"_v{corner}"))
        on = None
        for i in range(d):
            same = F.least(F.col(f"_i{i}") + up[i], F.lit(sizes[i] - 1)) == F.col(f"_b{i}")
            on = same if on is None else on & same
        at = at.join(F.broadcast(side), on, "left").drop(*(f"_b{i}" for i in range(d)))
        weight = F.lit(1.0)
        for i in range(d):
            weight = weight * (F.col(f"_f{i}") if up[i] else 1 - F.col(f"_f{i}"))
        total = total + weight * F.col(f"_v{corner}")
    return at.select(*df.columns, total.alias(name))


def error_model(points: DataFrame, at: DataFrame, value: str, columns: list[str], n_edges: int = 10) -> DataFrame:
    """``at`` (with ``columns``) with ``err``: the spread of ``value`` over ``points`` by quantile-edge bins of all columns, interpolated, and
    scaled so that standardised values (without those beyond seven spreads) have a spread of one."""
    points = stored(points.select(value, *columns).dropna(), "points")
    edges = quantile_edges(points, columns, n_edges)
    bins = stored(filled_bins(binned_spread(points, value, edges), edges), "spread")
    z = stored(interpolated(points, bins, edges, "err").select((F.col(value) / F.col("err")).alias("z")), "standardised")
    first = exact_nmad(z, [], "z").select("nmad")
    kept = z.join(F.broadcast(first)).where(F.abs("z") <= OUTLIER_SPREADS * F.col("nmad")).select("z")  # one row
    factor = exact_nmad(stored(kept, "kept"), [], "z").select(F.col("nmad").alias("_k"))
    return interpolated(at, bins, edges, "err").join(F.broadcast(factor)).withColumn("err", F.col("err") * F.col("_k")).drop("_k")  # one row


# --- polygons as rows ---------------------------------------------------------------------------------------


def edges_of(rings: DataFrame, keys: list[str], level: bool = False) -> DataFrame:
    """rings: keys and ``ring`` (array of struct<x, y>, closed or not; a polygon's holes are further rings). Their edges (x1, y1, x2, y2)
    and the ring's least x, ``x0``; level edges, which no scan line crosses, only with ``level``."""
    n = F.size("ring")
    each = rings.where(n >= 3).withColumn("i", F.explode(F.sequence(F.lit(1), n)))
    p, q = F.element_at("ring", F.col("i")), F.element_at("ring", F.col("i") % n + 1)
    return each.select(*keys, p["x"].cast("double").alias("x1"), p["y"].cast("double").alias("y1"), q["x"].cast("double").alias("x2"), q["y"].cast("double").alias("y2"), F.array_min(F.transform("ring", lambda v: v["x"])).cast("double").alias("x0")).where(F.lit(level) | (F.col("y1") != F.col("y2")))


def crossings(edges: DataFrame, keys: list[str], step: float = 1.0) -> DataFrame:
    """(keys, row, x): where each edge crosses the scan lines at y = row * step + step / 2; an edge counts from its lower end up to
    before its upper one, so a vertex on a line counts once. Edges are exploded to the rows they cross and nothing else."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = F.sequence(F.ceil(low / step - 0.5).cast("long"), (F.ceil(high / step - 0.5) - 1).cast("long"))
    some = F.ceil(low / step - 0.5) <= F.ceil(high / step - 0.5) - 1
    each = edges.where(some).withColumn("row", F.explode(rows))
    y = (F.col("row") + 0.5) * step
    return each.select(*keys, F.col("row").cast("int").alias("row"), ((F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("x"))


def spans(rings: DataFrame, keys: list[str], step: float = 1.0) -> DataFrame:
    """(keys, row, a, b): the stretches of every scan line that lie inside, by the parity of crossings: a < x <= b of a cell's centre.

    The crossings of one polygon with one line are ordered, a short list whatever the polygon's area.
    """
    x = crossings(edges_of(rings, keys), keys, step).groupBy(*keys, "row").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pair = F.explode(F.sequence(F.lit(1), F.floor(F.size("xs") / 2).cast("int")))
    each = x.where(F.size("xs") >= 2).withColumn("i", pair)
    return each.select(*keys, "row", F.element_at("xs", F.col("i") * 2 - 1).alias("a"), F.element_at("xs", F.col("i") * 2).alias("b"))


def burned(rings: DataFrame, keys: list[str], cols: tuple[int, int]) -> DataFrame:
    """(keys, r, c): the unit cells whose centres lie inside, columns within ``cols``: cells come from the spans, not from a test of each."""
    s = spans(rings, keys)
    # centres c + 0.5 with a <= c + 0.5 < b
    lo, hi = F.greatest(F.ceil(F.col("a") - 0.5).cast("int"), F.lit(cols[0])), F.least((F.ceil(F.col("b") - 0.5) - 1).cast("int"), F.lit(cols[1]))
    return s.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").select(*keys, F.col("row").alias("r"), F.explode(F.sequence("lo", "hi")).alias("c"))


def within(points: DataFrame, rings: DataFrame, keys: list[str], tile: float) -> DataFrame:
    """points (x, y and others) with the keys of every polygon that holds them: an equi-join of points and edges by square tiles.

    An edge is listed under the tiles of its own height from its ring's least x to its own greatest: only there can it be to the
    right of a point that the ring holds. Parity decides, so only sums by point and polygon are shuffled.
    """
    p = stored(points.withColumn("_p", F.monotonically_increasing_id()), "points")
    at = lambda v: F.floor(v / tile).cast("long")
    e = edges_of(rings, keys).withColumn("_ty", F.explode(F.sequence(at(F.least("y1", "y2")), at(F.greatest("y1", "y2")))))
    e = e.withColumn("_tx", F.explode(F.sequence(at(F.col("x0")), at(F.greatest("x1", "x2"))))).drop("x0")
    met = p.select("_p", F.col("x").alias("_x"), F.col("y").alias("_y")).withColumn("_tx", at(F.col("_x"))).withColumn("_ty", at(F.col("_y"))).join(e, ["_tx", "_ty"])
    crossed = ((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y"))) & (F.col("_x") < (F.col("x2") - F.col("x1")) * (F.col("_y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    inside = met.where(crossed).groupBy("_p", *keys).agg(F.count("*").alias("_n")).where("_n % 2 = 1").drop("_n")
    return p.join(inside, "_p").drop("_p")

