"""Warps of the reference grid into another system, projections there and back, warped bounds."""

from pyspark.sql import functions as F

from gridloom.operators import warp as P
from gridloom.plans.registry import query

#: The reference grid as a raster of a transverse Mercator zone: it spans this box at any number of rows.
SYSTEM, BOX, COLS = P.utm(33), (250000.0, 8500000.0, 650000.0, 9000000.0), 40


def grids(ref, factor: int = 1):
    """The reference grid, and one of the polar plane with as many cells over its outline (``factor`` times fewer on each axis)."""
    rows = ref.agg(F.max("r") + 1).first()[0] or 1
    x0, y0, x1, y1 = BOX
    source = P.Grid(SYSTEM, x0, y1, ((x1 - x0) / COLS, (y1 - y0) / rows), rows, COLS)
    return source, P.target_grid(ref.sparkSession, source, P.POLAR, shape=(-(-rows // factor), COLS // factor))


def sql_grids(factor: int = 1) -> str:
    """CTEs: b (the source's box and rows), o (its outline), g (both grids in one row), t (the target's cells with their place u, v)."""
    x0, y0, x1, y1 = BOX
    ox, oy = P.between(SYSTEM, P.POLAR, "ax", "ay")
    sx, sy = P.between(P.POLAR, SYSTEM, "(tx0 + (c + 0.5) * tw)", "(ty1 - (r + 0.5) * th)")
    return f"""b AS (SELECT {P.dec(x0)} AS x0, {P.dec(y0)} AS y0, {P.dec(x1)} AS x1, {P.dec(y1)} AS y1, (SELECT max(r) + 1 FROM ref) AS nr),
o AS (SELECT {ox} AS x, {oy} AS y FROM (SELECT {P.OUTLINE_X} AS ax, {P.OUTLINE_Y} AS ay FROM (SELECT b.*, i / {P.dec(P.OUTLINE - 1)} AS t FROM b, range({P.OUTLINE}) q(i)))),
g AS (SELECT b.*, nr AS rows, (x1 - x0) / {COLS} AS sw, (y1 - y0) / nr AS sh, tx0, ty1, tw, (ty1 - ty0) / tr AS th, tr FROM (SELECT b.*, (nr + {factor - 1}) // {factor} AS tr, (SELECT min(x) FROM o) AS tx0, (SELECT min(y) FROM o) AS ty0, (SELECT max(y) FROM o) AS ty1,
  ((SELECT max(x) FROM o) - (SELECT min(x) FROM o)) / {COLS // factor} AS tw FROM b) b),
t AS (SELECT r, c, sw, sh, tw, th, nr, ({sx} - x0) / sw AS u, (y1 - {sy}) / sh AS v FROM (SELECT g.*, r, c FROM g, (SELECT unnest(range(tr)) AS r FROM g), range({COLS // factor}) q(c)))"""


def sql_kernel(name: str) -> str:
    reach, kernel = P.KERNELS[name]
    return f""", e AS (SELECT t.r, t.c, s.r = floor(v) AND s.c = floor(u) AS here, s.ref_z AS z, least(1.0, sw / tw) AS fx, least(1.0, sh / th) AS fy, (s.c + 0.5 - u) * least(1.0, sw / tw) AS x, (s.r + 0.5 - v) * least(1.0, sh / th) AS y
  FROM t JOIN ref s ON s.slope <> 7 AND s.r BETWEEN floor(v - 0.5) + 1 - ceil({reach} / least(1.0, sh / th)) AND floor(v - 0.5) + ceil({reach} / least(1.0, sh / th)) AND s.c BETWEEN floor(u - 0.5) + 1 - ceil({reach} / least(1.0, sw / tw)) AND floor(u - 0.5) + ceil({reach} / least(1.0, sw / tw))
  WHERE u >= 0 AND u < {COLS} AND v >= 0 AND v < nr),
k AS (SELECT r, c, sum(w * z) / sum(w) AS z, bool_or(here) AND sum(w) > 1e-5 AS good FROM (SELECT *, ({kernel('x')}) * ({kernel('y')}) AS w FROM e) GROUP BY r, c)
SELECT CAST(t.r AS INT) AS r, CAST(t.c AS INT) AS c, round(CASE WHEN good THEN k.z END, 3) AS z FROM t LEFT JOIN k USING (r, c)"""


def warped(ref, resampling: str, factor: int = 1):
    source, target = grids(ref, factor)
    have = ref.select("r", "c", F.when(F.col("slope") == 7, -9999.0).otherwise(F.col("ref_z")).alias("z"))
    return P.warp(have, source, target, "z", resampling, -9999.0, float("nan")).select("r", "c", F.round("z", 3).alias("z"))


def register_kernel(name: str, factor: int = 1):
    @query("ref", sql_kernel(name), sql_grids(factor), name=f"r22_warp_{name}" + ("_coarse" if factor > 1 else ""))
    def run(ref):
        return warped(ref, name, factor)

    run.__doc__ = f"R22: the grid resampled into another system by {name}, without its missing cells."


for _name in P.KERNELS:
    register_kernel(_name)
register_kernel("cubic", 3)


@query("ref", " SELECT CAST(t.r AS INT) AS r, CAST(t.c AS INT) AS c, coalesce(CASE WHEN s.slope <> 7 THEN ref_z END, 0) AS z FROM t LEFT JOIN ref s ON s.r = floor(v) AND s.c = floor(u)", sql_grids())
def r22_warp_nearest(ref):
    """The source cell under each target cell's centre; 0 where there is none, as no other value is asked for."""
    source, target = grids(ref)
    return P.warp(ref.where("slope <> 7"), source, target, "ref_z", "nearest")


INTO = P.between(SYSTEM, P.POLAR, "(x0 + (c + 0.5) * sw)", "(y1 - (r + 0.5) * sh)")
MOVED = f""", m AS (SELECT floor((px - tx0) / tw) AS c, floor((ty1 - py) / th) AS r, ref_z AS z, slope FROM (SELECT g.*, ref_z, slope, {INTO[0]} AS px, {INTO[1]} AS py FROM ref, g)),
y AS (SELECT r, c, avg(z) AS average, median(z) AS med, max(z) AS max, quantile_cont(z, 0.75) AS q3, min(w) FILTER (n = most) AS mode FROM (SELECT *, max(n) OVER (PARTITION BY r, c) AS most FROM (SELECT *, slope AS w, count(*) OVER (PARTITION BY r, c, slope) AS n FROM m)) GROUP BY r, c)
SELECT CAST(t.r AS INT) AS r, CAST(t.c AS INT) AS c, round(average, 6) AS average, med, max, round(q3, 6) AS q3, CAST(mode AS DOUBLE) AS mode FROM t LEFT JOIN y USING (r, c)"""


@query("ref", MOVED, sql_grids(4))
def r22_warp_statistics(ref):
    """Of the cells that a coarse target cell holds the average, median, greatest value, upper quartile, and the commonest slope."""
    source, target = grids(ref, 4)
    nan = float("nan")
    out = None
    for name in ("average", "med", "max", "q3", "mode"):
        got = P.warp(ref, source, target, "slope" if name == "mode" else "ref_z", name, dst_nodata=nan)
        got = got.select("r", "c", (F.round("z", 6) if name in ("average", "q3") else F.col("z")).alias(name))
        out = got if out is None else out.join(got, ["r", "c"])
    return out


THERE = P.between(P.DEGREES, P.utm(33), "lon", "lat"), P.between(P.DEGREES, P.POLAR, "lon", "lat")
BACK = P.between(P.utm(33), P.DEGREES, "e", "n"), P.between(P.POLAR, P.DEGREES, "px", "py")
GONE = f"SELECT pid, lon, lat, {THERE[0][0]} AS e, {THERE[0][1]} AS n, {THERE[1][0]} AS px, {THERE[1][1]} AS py FROM (SELECT pid, 12.0::DOUBLE + x * 0.15::DOUBLE AS lon, 76.0::DOUBLE + (y % 60) * 0.08::DOUBLE AS lat FROM pts)"
RETURNED = [f"round({t}, 8) AS {n}" for t, n in zip((*BACK[0], *BACK[1]), ("utm_lon", "utm_lat", "polar_lon", "polar_lat"), strict=True)]


@query("pts", f"SELECT pid, round(e, 3) AS e, round(n, 3) AS n, {', '.join(RETURNED)} FROM ({GONE})")
def r23_there_and_back(pts):
    """Degrees to two planes and back, by closed expressions."""
    at = pts.selectExpr("pid", "cast(12.0 as double) + x * cast(0.15 as double) AS lon", "cast(76.0 as double) + (y % 60) * cast(0.08 as double) AS lat")
    gone = at.selectExpr("pid", f"{THERE[0][0]} AS e", f"{THERE[0][1]} AS n", f"{THERE[1][0]} AS px", f"{THERE[1][1]} AS py")
    return gone.selectExpr("pid", "round(e, 3) AS e", "round(n, 3) AS n", *RETURNED)


DEGREES_X, DEGREES_Y = "CAST(10 AS DOUBLE) + {} * 0.3", "CAST(76 AS DOUBLE) + {} * 0.08"
TO_X, TO_Y = P.between(P.DEGREES, P.POLAR, "ax", "ay")
OUTLINED = f""", q AS (SELECT strip, {', '.join(f"{(DEGREES_X if v[0] == 'x' else DEGREES_Y).format(v)} AS {v}" for v in ('x0', 'y0', 'x1', 'y1'))} FROM strips),
w AS (SELECT strip, {TO_X} AS wx, {TO_Y} AS wy FROM (SELECT strip, {P.OUTLINE_X} AS ax, {P.OUTLINE_Y} AS ay FROM (SELECT q.*, i / {P.dec(P.OUTLINE - 1)} AS t FROM q, range({P.OUTLINE}) z(i))))
SELECT strip, round(min(wx), 3) AS x0, round(min(wy), 3) AS y0, round(max(wx), 3) AS x1, round(max(wy), 3) AS y1 FROM w GROUP BY strip"""


@query("strips", OUTLINED)
def u_warped_bounds(strips):
    """Bounds of every strip's box in another system, by fifty places along its outline."""
    boxes = strips.selectExpr("strip", *(f"{(DEGREES_X if v[0] == 'x' else DEGREES_Y).format(v)} AS {v}" for v in ("x0", "y0", "x1", "y1")))
    return P.warp_bounds(boxes, ["strip"], P.DEGREES, P.POLAR).select("strip", *(F.round(v, 3).alias(v) for v in ("x0", "y0", "x1", "y1")))
