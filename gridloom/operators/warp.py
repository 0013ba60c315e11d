"""Raster to raster: projections and their inverses, warped bounds, target grids, resampling by kernels and by statistics.

Expressions are texts that Spark and the oracle both read. A target cell's centre is taken back through degrees to the source's
plane by closed expressions; the source cells under a kernel are an equi-join on their places. Nothing is gathered but the one
row of a grid's bounds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import surface as S
from gridloom.sources.files import shared_base

#: Points along a box's outline that are projected for its bounds in another system.
OUTLINE = 50


def dec(x: float) -> str:
    return f"cast({float(x)!r} as double)"


def utm_inverse(e: str, n: str, meridian: float) -> tuple[str, str]:
    """Longitude and latitude of a transverse Mercator easting and northing, by series of three terms (to under a millimetre)."""
    radius, _, _ = S.series_terms()
    k = S.FLAT / (2 - S.FLAT)
    back = [k / 2 - 2 * k**2 / 3 + 37 * k**3 / 96, k**2 / 48 + k**3 / 15, 17 * k**3 / 480]
    rise = [2 * k - 2 * k**2 / 3 - 2 * k**3, 7 * k**2 / 3 - 8 * k**3 / 5, 56 * k**3 / 15]
    scale = dec(S.SCALE * radius)
    xi, eta = f"(({n}) / {scale})", f"((({e}) - {dec(S.EAST)}) / {scale})"
    less = lambda f, g: " - ".join(f"{dec(b)} * {f}({2 * (j + 1)} * {xi}) * {g}({2 * (j + 1)} * {eta})" for j, b in enumerate(back))
    xi2, eta2 = f"({xi} - {less('sin', 'cosh')})", f"({eta} - {less('cos', 'sinh')})"
    chi = f"asin(sin({xi2}) / cosh({eta2}))"
    lat = f"degrees({chi} + " + " + ".join(f"{dec(d)} * sin({2 * (j + 1)} * {chi})" for j, d in enumerate(rise)) + ")"
    return f"({dec(meridian)} + degrees(atan2(sinh({eta2}), cos({xi2}))))", f"({lat})"


def polar_inverse(x: str, y: str, meridian: float = -45.0, true_lat: float = 70.0) -> tuple[str, str]:
    """Longitude and latitude of polar stereographic x and y (north)."""
    q = S.FLAT * (2 - S.FLAT)
    e, true = math.sqrt(q), math.radians(true_lat)
    tight = math.tan(math.pi / 4 - true / 2) / ((1 - e * math.sin(true)) / (1 + e * math.sin(true))) ** (e / 2)
    scale = S.AXIS * math.cos(true) / math.sqrt(1 - (e * math.sin(true)) ** 2) / tight
    terms = [q / 2 + 5 * q**2 / 24 + q**3 / 12 + 13 * q**4 / 360, 7 * q**2 / 48 + 29 * q**3 / 240 + 811 * q**4 / 11520, 7 * q**3 / 120 + 81 * q**4 / 1120, 4279 * q**4 / 161280]
    chi = f"({dec(math.pi / 2)} - 2 * atan(sqrt(({x}) * ({x}) + ({y}) * ({y})) / {dec(scale)}))"
    lat = f"degrees({chi} + " + " + ".join(f"{dec(t)} * sin({2 * (j + 1)} * {chi})" for j, t in enumerate(terms)) + ")"
    return f"({dec(meridian)} + degrees(atan2({x}, -1 * ({y}))))", f"({lat})"


@dataclass(frozen=True)
class System:
    """A reference system: ``forward`` takes (longitude, latitude) texts to (x, y), ``inverse`` back."""

    name: str
    forward: Callable[[str, str], tuple[str, str]] = field(compare=False)
    inverse: Callable[[str, str], tuple[str, str]] = field(compare=False)


DEGREES = System("degrees", lambda lon, lat: (lon, lat), lambda x, y: (x, y))


def utm(zone: int) -> System:
    """A northern zone of WGS 84."""
    meridian = zone * 6.0 - 183
    return System(f"utm{zone}", lambda lon, lat: S.utm_text(lon, lat, meridian), lambda x, y: utm_inverse(x, y, meridian))


POLAR = System("polar", S.polar_text, polar_inverse)


def between(a: System, b: System, x: str, y: str) -> tuple[str, str]:
    """Texts of x and y of system ``a`` in system ``b``."""
    return (x, y) if a.name == b.name else b.forward(*a.inverse(x, y))


# --- grids ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Grid:
    """``rows`` x ``cols`` cells of ``res`` (width, height) from the upper left corner (left, top) on."""

    system: System
    left: float
    top: float
    res: tuple[float, float]
    rows: int
    cols: int

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.left, self.top - self.rows * self.res[1], self.left + self.cols * self.res[0], self.top


#: The place at share t (of 1) along a box's outline, from the lower right corner on upwards; boxes are x0, y0, x1, y1.
ALONG = "(t * 2 * ((x1 - x0) + (y1 - y0)))"
OUTLINE_X = f"CASE WHEN {ALONG} <= y1 - y0 THEN x1 WHEN {ALONG} <= (y1 - y0) + (x1 - x0) THEN x1 - ({ALONG} - (y1 - y0)) WHEN {ALONG} <= 2 * (y1 - y0) + (x1 - x0) THEN x0 ELSE x0 + ({ALONG} - 2 * (y1 - y0) - (x1 - x0)) END"
OUTLINE_Y = f"CASE WHEN {ALONG} <= y1 - y0 THEN y0 + {ALONG} WHEN {ALONG} <= (y1 - y0) + (x1 - x0) THEN y1 WHEN {ALONG} <= 2 * (y1 - y0) + (x1 - x0) THEN y1 - ({ALONG} - (y1 - y0) - (x1 - x0)) ELSE y0 END"


def warp_bounds(boxes: DataFrame, keys: list[str], a: System, b: System, points: int = OUTLINE) -> DataFrame:
    """keys and the bounds (x0, y0, x1, y1) in system ``b`` of each box of system ``a``, by ``points`` places along its outline."""
    each = boxes.select(*keys, *("x0", "y0", "x1", "y1"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    at = each.withColumn("t", F.col("i") / float(points - 1)).selectExpr(*keys, f"{OUTLINE_X} AS ax", f"{OUTLINE_Y} AS ay")
    bx, by = between(a, b, "ax", "ay")
    at = at.selectExpr(*keys, f"{bx} AS bx", f"{by} AS by")
    return at.groupBy(*keys).agg(F.min("bx").alias("x0"), F.min("by").alias("y0"), F.max("bx").alias("x1"), F.max("by").alias("y1"))


def target_grid(
    spark: SparkSession, source: Grid, system: System | None = None, res: float | tuple[float, float] | None = None, shape: tuple[int, int] | None = None,
    bounds: tuple[float, float, float, float] | None = None, transform: tuple[float, float, float, float] | None = None,
) -> Grid:
    """The grid that a warp writes. ``transform`` is (left, top, width, height of a cell) and needs ``shape``; it excludes ``res`` and
    ``bounds``; ``shape`` excludes ``res``. Without bounds the source's outline is projected; without a resolution the diagonal
    keeps its number of cells. Bounds that ``res`` doesn't divide grow to the right and down."""
    system = system or source.system
    if transform is not None and shape is None:
        raise ValueError("transform needs shape")
    if transform is not None and res is not None:
        raise ValueError("transform and res exclude each other")
    if transform is not None and bounds is not None:
        raise ValueError("transform and bounds exclude each other")
    if shape is not None and res is not None:
        raise ValueError("shape and res exclude each other")
    if transform is not None:
        return Grid(system, transform[0], transform[1], (transform[2], transform[3]), *shape)
    if bounds is None:
        if system.name == source.system.name:
            bounds = source.bounds
        else:
            box = spark.range(1).select(*(F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), source.bounds, strict=True)))
            bounds = tuple(warp_bounds(box, [], source.system, system).first())
    left, bottom, right, top = bounds
    if shape is not None:
        return Grid(system, left, top, ((right - left) / shape[1], (top - bottom) / shape[0]), *shape)
    if res is None:
        res = source.res if system.name == source.system.name else math.hypot(right - left, top - bottom) / math.hypot(source.rows, source.cols)
    across, down = res if isinstance(res, tuple) else (res, res)
    count = lambda length, step: max(1, math.ceil(length / step - 1e-9))
    return Grid(system, left, top, (across, down), count(top - bottom, down), count(right - left, across))


# --- resampling -------------------------------------------------------------------------------------------

#: Kernels as texts of the distance in cells, with their reach.
KERNELS: dict[str, tuple[int, Callable[[str], str]]] = {
    "bilinear": (1, lambda x: f"greatest(0.0, 1 - abs({x}))"),
    "cubic": (2, lambda x: f"CASE WHEN abs({x}) < 1 THEN (1.5 * abs({x}) - 2.5) * abs({x}) * abs({x}) + 1 WHEN abs({x}) < 2 THEN ((2.5 - 0.5 * abs({x})) * abs({x}) - 4) * abs({x}) + 2 ELSE 0.0 END"),
    "cubic_spline": (2, lambda x: f"CASE WHEN abs({x}) < 1 THEN {dec(2 / 3)} + (0.5 * abs({x}) - 1) * abs({x}) * abs({x}) WHEN abs({x}) < 2 THEN (2 - abs({x})) * (2 - abs({x})) * (2 - abs({x})) / 6 ELSE 0.0 END"),
    "lanczos": (3, lambda x: f"CASE WHEN abs({x}) < 1e-9 THEN 1.0 WHEN abs({x}) < 3 THEN 3 * sin(pi() * {x}) * sin(pi() * {x} / 3) / (pi() * pi() * {x} * {x}) ELSE 0.0 END"),
}
#: Statistics of the source cells whose centre a target cell holds.
STATISTICS = {
    "average": F.avg, "min": F.min, "max": F.max, "med": F.median, "sum": F.sum, "rms": lambda c: F.sqrt(F.avg(F.col(c) * F.col(c))), "mode": lambda c: F.mode(c, True),
    "q1": lambda c: F.percentile(c, 0.25), "q3": lambda c: F.percentile(c, 0.75),
}
#: The two methods whose name in the warping library isn't theirs with a capital.
RENAMED = {"nearest": "NearestNeighbour", "cubic_spline": "CubicSpline"}


def library_name(resampling: str) -> str:
    """A method's name as the warping library has it."""
    if resampling != "nearest" and resampling not in KERNELS and resampling not in STATISTICS:
        raise KeyError(resampling)
    return RENAMED.get(resampling, resampling.capitalize())


def located(grid: Grid, other: System, r: str = "r", c: str = "c") -> tuple[str, str]:
    """Texts of a cell's centre in another system."""
    x, y = f"({dec(grid.left)} + ({c} + 0.5) * {dec(grid.res[0])})", f"({dec(grid.top)} - ({r} + 0.5) * {dec(grid.res[1])})"
    return between(grid.system, other, x, y)


def pixels(grid: Grid, x: str, y: str) -> tuple[str, str]:
    """Texts of a place as fractional column and row."""
    return f"(({x}) - {dec(grid.left)}) / {dec(grid.res[0])}", f"({dec(grid.top)} - ({y})) / {dec(grid.res[1])}"


def grid_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    return spark.range(grid.rows * grid.cols).select(F.floor(F.col("id") / grid.cols).cast("int").alias("r"), (F.col("id") % grid.cols).cast("int").alias("c"))


def shrink(source: Grid, target: Grid) -> tuple[float, float]:
    """Shares by which kernels are stretched where the target is coarser (1: not at all); only for grids in metres."""
    metres = "degrees" not in (source.system.name, target.system.name)
    return tuple(min(1.0, s / t) if metres else 1.0 for s, t in zip(source.res, target.res, strict=True))


def warp(cells: DataFrame, source: Grid, target: Grid, value: str = "z", resampling: str = "bilinear", src_nodata: float | None = None, dst_nodata: float | None = None) -> DataFrame:
    """(r, c, z) of every cell of ``target``: ``cells`` (r, c, value) of ``source`` resampled.

    Kernels weigh the source cells that are there and divide by their weights; a target cell whose centre lies on a missing source
    cell or outside has no value. No value is ``dst_nodata``: 0 if none is given, null if it is NaN. Statistics take the source
    cells whose centres a target cell holds. Cells equal to ``src_nodata`` are missing.
    """
    library_name(resampling)
    gone = F.col(value).isNull() if src_nodata is None else F.col(value).isNull() | (F.col(value) == src_nodata)
    have = cells.where(~gone).select("r", "c", F.col(value).cast("double").alias("z"))
    at = grid_cells(cells.sparkSession, target)
    if resampling in STATISTICS:
        u, v = pixels(target, *located(source, target.system))
        moved = have.selectExpr(f"cast(floor({v}) as int) AS r", f"cast(floor({u}) as int) AS c", "z")
        got = at.join(moved.groupBy("r", "c").agg(STATISTICS[resampling]("z").alias("z")), ["r", "c"], "left")
    else:
        u, v = pixels(source, *located(target, source.system))
        at = at.selectExpr("r", "c", f"{u} AS u", f"{v} AS v")
        if resampling == "nearest":
            near = at.selectExpr("r AS tr", "c AS tc", "cast(floor(v) as int) AS r", "cast(floor(u) as int) AS c")
            got = near.join(have, ["r", "c"], "left").select(F.col("tr").alias("r"), F.col("tc").alias("c"), "z")
        else:
            got = _weighed(at, have, source, target, *KERNELS[resampling])
    fill = 0.0 if dst_nodata is None else dst_nodata
    return got if math.isnan(fill) else got.withColumn("z", F.coalesce("z", F.lit(float(fill))))


def _weighed(at: DataFrame, have: DataFrame, source: Grid, target: Grid, reach: int, kernel: Callable[[str], str]) -> DataFrame:
    sx, sy = shrink(source, target)
    steps = lambda s: range(1 - math.ceil(reach / s), math.ceil(reach / s) + 1)
    offsets = F.array(*(F.struct(F.lit(j).alias("dr"), F.lit(i).alias("dc")) for j in steps(sy) for i in steps(sx)))
    outside = F.array(F.struct(F.lit(None).cast("int").alias("dr"), F.lit(None).cast("int").alias("dc")))
    inside = f"u >= 0 AND u < {source.cols} AND v >= 0 AND v < {source.rows}"
    each = at.withColumn("o", F.explode(F.when(F.expr(inside), offsets).otherwise(outside)))
    each = each.selectExpr("r AS tr", "c AS tc", "u", "v", "cast(floor(v - 0.5) as int) + o.dr AS r", "cast(floor(u - 0.5) as int) + o.dc AS c")
    x, y = f"((c + 0.5 - u) * {dec(sx)})", f"((r + 0.5 - v) * {dec(sy)})"
    seen = each.selectExpr("tr", "tc", "r", "c", f"({kernel(x)}) * ({kernel(y)}) AS w", "r = floor(v) AND c = floor(u) AS here").join(have, ["r", "c"], "left")
    some = F.col("z").isNotNull()
    got = seen.groupBy("tr", "tc").agg(F.sum(F.when(some, F.col("w") * F.col("z"))).alias("s"), F.sum(F.when(some, F.col("w"))).alias("w"), F.coalesce(F.bool_or(F.col("here") & some), F.lit(False)).alias("here"))
    return got.select(F.col("tr").alias("r"), F.col("tc").alias("c"), F.when(F.col("here") & (F.col("w") > 1e-5), F.col("s") / F.col("w")).alias("z"))


# --- results kept by their arguments ------------------------------------------------------------------------


def remembered(spark: SparkSession, name: str, arguments: list, make: Callable[[], DataFrame], redo: bool = False) -> DataFrame:
    """What ``make`` gives, written once to the shared folder under a name of all ``arguments`` (by their texts); later calls with the
    same name and arguments read it. ``redo`` writes it again. ``make`` must not read what it replaces."""
    text = "".join(f"{len(str(a))}:{a}" for a in arguments)
    path = f"{shared_base(spark)}/{name}-{hashlib.sha256(text.encode()).hexdigest()}"
    if not redo:
        try:
            spark.read.text(f"{path}/_SUCCESS")
            return spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
