"""Bias across the gaps of a trend, and experiments with square gaps: how far a filled gap is off by its area and by the distance to its edge."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import grid as G
from gridloom.operators.quantiles import exact_nmad
from gridloom.operators.radial import radial_surface
from gridloom.sources.files import stored

#: The greatest spread and difference of a pair at a gap's edge, and the greatest distance of its cells (in cells).
PAIR_NMAD, PAIR_DIFFERENCE, PAIR_REACH = 2.0, 0.6, 2.0
#: Bins of the distance curve and by how much they reach beyond its ends.
DISTANCE_BINS, MARGIN = 49, 0.01


def edge_bins(valid: DataFrame, gone: DataFrame, keys: tuple[str, ...] = (), outside: Column | None = None) -> DataFrame:
    """Pairs of a valid cell at a gap's edge and the nearest missing one within reach; medians of the differences that pass the gates,
    by ``keys`` of the missing cells and bins of 4 x 4 cells.

    valid and gone: r, c, b, nmad (gone with ``keys`` and what ``outside`` reads). ``outside`` says which cells around a missing one
    may be valid, where ``valid`` alone doesn't.
    """
    around = [o for o in G.SQUARE if o != (0, 0)]  # 3 x 3 dilation: a neighbour is within the reach of two cells
    near = G.neighbours(gone.withColumnsRenamed({"b": "bi", "nmad": "ni"}), around)
    near = near if outside is None else near.where(outside)
    d = (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("d")
    near = near.select(*keys, "r", "c", F.struct(d, (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "bi", "ni").alias("i")).where(F.sqrt("i.d") < PAIR_REACH)
    first = near.groupBy(*keys, "r", "c").agg(F.min_by("i", F.struct("i.d", "i.r", "i.c")).alias("i"))
    p = valid.select("r", "c", "b", "nmad").join(first, ["r", "c"]).withColumn("diff", F.col("b") - F.col("i.bi"))
    p = p.where((F.greatest("nmad", "i.ni") < PAIR_NMAD) & (F.abs("diff") < PAIR_DIFFERENCE))
    p = p.select(*keys, ((F.col("c") + F.col("i.c")) / 2 + 0.5).alias("x"), ((F.col("r") + F.col("i.r")) / 2 + 0.5).alias("y"), F.col("diff").alias("v"))
    return p.groupBy(*keys, F.floor(F.col("x") / 4).alias("bx"), F.floor(F.col("y") / 4).alias("by")).agg(*(F.median(c).alias(c) for c in "xyv"), F.count("*").alias("n"))


def gap_starts(chunk: int, size: int, edge: int, inner: int, smallest: int, most: int, least: int) -> tuple[list[int], list[int]]:
    """First rows and columns of the square gaps of ``size`` cells that a chunk of ``chunk`` x ``chunk`` cells gets.

    Gaps keep ``edge`` cells from the rim and ``inner`` from one another. As many are wanted as their area is smaller than that of
    ``smallest`` cells' ``most``, ``least`` at least, as far as they fit; of the arrangements with the most gaps the squarest is taken, of two
    as square that with more rows.
    """
    if edge < 1 or inner < 1:
        raise ValueError("gaps need a cell around them")
    room = chunk - 2 * edge
    if size < 1 or size > room:
        raise ValueError(f"a gap of {size} cells doesn't fit a chunk of {chunk}")
    fit = 1 + (room - size) // (size + inner)
    want = min(fit * fit, max(least, round(most * (smallest / size) ** 2)))
    n_rows, n_cols = max(((k, min(fit, want // k)) for k in range(1, min(fit, want) + 1)), key=lambda s: (s[0] * s[1], -round(abs(math.log(s[1] / s[0])), 9), s[0]))
    last = chunk - edge - size
    starts = lambda n: [(edge + last) // 2] if n == 1 else [int(x) for x in np.round(np.linspace(edge, last, n))]
    return starts(n_rows), starts(n_cols)


def gap_cells(cells: DataFrame, layouts: dict[int, tuple[list[int], list[int]]], chunk: int) -> DataFrame:
    """``cells`` (r, c and others) that lie in a gap, once for each size: size, gr and gc (the gap's first row and column), d (the distance
    to the nearest cell outside, which for a square is that to its nearest side).

    Every chunk has the same gaps, so which one holds a cell is an expression; no gap is joined or listed.
    """
    place = lambda axis, starts, size: F.array_max(F.filter(F.array(*map(F.lit, starts)), lambda s: (s <= F.pmod(F.col(axis), F.lit(chunk))) & (F.pmod(F.col(axis), F.lit(chunk)) < s + size)))
    each = [F.struct(F.lit(size).alias("size"), place("r", rows, size).alias("r0"), place("c", cols, size).alias("c0")) for size, (rows, cols) in layouts.items()]
    held = cells.withColumn("_g", F.explode(F.filter(F.array(*each), lambda g: g["r0"].isNotNull() & g["c0"].isNotNull())))
    first = lambda axis, at: F.col(axis) - F.pmod(F.col(axis), F.lit(chunk)) + F.col(at)
    held = held.withColumns({"size": F.col("_g.size"), "gr": first("r", "_g.r0"), "gc": first("c", "_g.c0")}).drop("_g")
    sides = [s for axis, at in (("r", "gr"), ("c", "gc")) for s in (F.col(axis) - F.col(at) + 1, F.col(at) + F.col("size") - F.col(axis))]
    return held.withColumn("d", F.least(*sides))


def gap_errors(cells: DataFrame, layouts: dict[int, tuple[list[int], list[int]]], chunk: int) -> DataFrame:
    """cells: r, c, b (the trend), w (the trend without the last year), nmad, ice. Each gap is filled with ``w`` and corrected by the
    surface through the differences across its edges: size, gr, gc, r, c, d, raw (error before the correction), diff (after it).

    Cells off the ice get no correction. Where no pair at the edges of a size passes the gates, its ``diff`` is null. Pairs of all
    sizes are one plan and come from the gaps' rims only; surfaces are made size by size.
    """
    cells = stored(cells.select("r", "c", "b", "w", "nmad", "ice"), "trends")
    held = stored(gap_cells(cells, layouts, chunk), "gaps")
    rim = held.where("ice and d = 1").select("size", "gr", "gc", "r", "c", F.col("w").alias("b"), "nmad")
    inside = F.col("r").between(F.col("gr"), F.col("gr") + F.col("size") - 1) & F.col("c").between(F.col("gc"), F.col("gc") + F.col("size") - 1)
    bins = stored(edge_bins(cells.where("ice"), rim, ("size",), ~inside), "edges")
    parts = []
    for size in layouts:
        at = held.where((F.col("size") == size) & F.col("ice")).select("size", "gr", "gc", "r", "c", (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"), "b", "w", "d")
        got = radial_surface(bins.where(F.col("size") == size).select("x", "y", "v"), at)
        parts.append(got.select("size", "gr", "gc", "r", "c", "d", (F.col("w") - F.col("b")).alias("raw"), (F.col("w") + F.col("z") - F.col("b")).alias("diff")))
    raw = F.col("w") - F.col("b")
    parts.append(held.where("not ice").select("size", "gr", "gc", "r", "c", "d", raw.alias("raw"), raw.alias("diff")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def area_curve(errors: DataFrame, value: str = "diff") -> DataFrame:
    """size, area, nmad, n: the spread of the gaps' mean errors by area."""
    means = stored(errors.groupBy("size", "gr", "gc").agg(F.avg(value).alias("mean")).where("mean is not null"), "means")
    return exact_nmad(means, ["size"], "mean").select("size", (F.col("size") * F.col("size")).alias("area"), "nmad", "n")


def distance_curve(errors: DataFrame, value: str = "diff") -> DataFrame:
    """bin, distance (the bin's middle), nmad, n: the spread of cells' errors by the distance to the gap's edge."""
    e = stored(errors.where(F.col(value).isNotNull()).select("d", value), "errors")
    ends = e.agg((F.max("d") + MARGIN).alias("hi"))  # one row
    width = (F.col("hi") + MARGIN) / DISTANCE_BINS
    binned = e.join(F.broadcast(ends)).select(F.floor((F.col("d") + MARGIN) / width).cast("int").alias("bin"), width.alias("width"), value)
    got = exact_nmad(stored(binned, "binned"), ["bin", "width"], value)
    return got.select("bin", ((F.col("bin") + 0.5) * F.col("width") - MARGIN).alias("distance"), "nmad", "n")
