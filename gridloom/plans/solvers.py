"""Trends with use flags, gap experiments, training sets and classifiers, error models, planes, streams and user functions."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.functions import columns as C
from gridloom.operators import gaps
from gridloom.operators import grid as G
from gridloom.operators import outlines as O
from gridloom.operators import registration
from gridloom.operators import solvers as V
from gridloom.operators import surface as S
from gridloom.operators.radial import radial_surface
from gridloom.operators.trends import polynomial_fit, robust_trend
from gridloom.plans.registry import query
from gridloom.plans.stacks import replicate_pairs
from gridloom.plans.surfaces import EDGES, INSIDE, RINGS
from gridloom.plans.trends import ROUGH, by_flags, flagged, trend_sql
from gridloom.sources import cubes, files
from gridloom.sources.adapters import TILE
from gridloom.streaming import tiles as stream

USED = """, y AS (SELECT r, c, yr - 1995 AS t, median(z)/100 AS z, count(*) AS n FROM obs GROUP BY r, c, yr), f AS (SELECT r, c, regr_slope(z, t) AS b, regr_intercept(z, t) AS a FROM y GROUP BY r, c HAVING count(*) >= 2),
e AS (SELECT y.*, z - b*t - a AS e FROM y JOIN f USING (r, c)), m AS (SELECT r, c, median(e) AS m FROM e GROUP BY r, c), s AS (SELECT r, c, 1.4826::DOUBLE*median(abs(e-m)) AS nmad FROM e JOIN m USING (r, c) GROUP BY r, c)
SELECT r, c, t, t >= -2 AND n >= 2 AND NOT (abs(round(e, 9)) > greatest(0.5, 3*round(nmad, 9)) AND n < 4) AS used FROM e JOIN s USING (r, c)"""


@query("obs", USED)
def r29_use_flags(obs):
    """Yearly values are used from a first year on, with enough observations, unless they are far off the line and thin."""
    y = obs.groupBy("r", "c", (F.col("yr") - 1995).alias("t")).agg((F.median("z") / 100).alias("z"), F.count("*").alias("n"))
    fit = G.linear_trend(y.drop("n"), ["r", "c"], "t", "z").where("n >= 2").select("r", "c", "slope", "intercept", "nmad")
    e = y.join(fit, ["r", "c"]).withColumn("e", F.round(F.col("z") - F.col("slope") * F.col("t") - F.col("intercept"), 9))
    off = (F.abs("e") > F.greatest(F.lit(0.5), 3 * F.round("nmad", 9))) & (F.col("n") < 4)
    return e.select("r", "c", "t", ((F.col("t") >= -2) & (F.col("n") >= 2) & ~off).alias("used"))


#: The first year used, the least count of a year, the count below which far values go, and how far is far.
FIRST_YEAR, LEAST_COUNT, THIN, FAR = 1996, 3, 4, 5.0
BLOCK_YEARS = f"""q AS (SELECT r // 2 AS br, c // 2 AS bc, yr, date_trunc('month', d) AS m, median(z) AS z FROM obs GROUP BY ALL), y AS (SELECT br, bc, yr, yr - 1998 AS t, median(z) AS z, stddev_pop(z) AS std, count(*) AS n FROM q GROUP BY br, bc, yr)"""
USED_YEARS = f"""u AS (SELECT y.*, nmad, yr >= {FIRST_YEAR} AND y.n >= {LEAST_COUNT} AND NOT (abs(round(z - b*t - a, 9)) > greatest({FAR}, 3 * round(nmad, 9)) AND y.n < {THIN}) AS used FROM y JOIN f USING (br, bc)),
o AS (SELECT br, bc, t, z, t - avg(t) OVER k AS p1 FROM u WHERE used WINDOW k AS (PARTITION BY br, bc)), o2 AS (SELECT *, sum(p1*p1) OVER k AS s1, p1*p1 - avg(p1*p1) OVER k - CASE WHEN sum(p1*p1) OVER k > 1e-9 THEN p1 * sum(p1*p1*p1) OVER k / sum(p1*p1) OVER k ELSE 0 END AS p2 FROM o WINDOW k AS (PARTITION BY br, bc)),
o3 AS (SELECT *, sum(p2*p2) OVER k AS s2, p1*p1*p1 - avg(p1*p1*p1) OVER k - CASE WHEN s1 > 1e-9 THEN p1 * sum(p1*p1*p1*p1) OVER k / s1 ELSE 0 END - CASE WHEN sum(p2*p2) OVER k > 1e-9 THEN p2 * sum(p1*p1*p1*p2) OVER k / sum(p2*p2) OVER k ELSE 0 END AS p3 FROM o2 WINDOW k AS (PARTITION BY br, bc)),
o4 AS (SELECT br, bc, t, avg(z) OVER k + CASE WHEN s1 > 1e-9 THEN p1 * sum(p1*z) OVER k / s1 ELSE 0 END + CASE WHEN s2 > 1e-9 THEN p2 * sum(p2*z) OVER k / s2 ELSE 0 END + CASE WHEN sum(p3*p3) OVER k > 1e-9 THEN p3 * sum(p3*z) OVER k / sum(p3*p3) OVER k ELSE 0 END AS fitted FROM o3 WINDOW k AS (PARTITION BY br, bc))"""
#: Added to values while they are rounded: they are often short decimals, and exact halves would be rounded by their last bit.
OFFSET = 0.0031415926
TREND_POLYNOMIAL = f"""SELECT CAST(br AS INT) AS br, CAST(bc AS INT) AS bc, yr, round(z, 6) AS z, round(std, 6) AS std, n, round(nmad, 4) AS nmad, used, CAST(min(yr) FILTER (used) OVER (PARTITION BY br, bc) AS INT) AS first_yr, CAST(max(yr) FILTER (used) OVER (PARTITION BY br, bc) AS INT) AS last_yr, round(fitted + {OFFSET}::DOUBLE, 5) - {OFFSET}::DOUBLE AS fitted
FROM u LEFT JOIN o4 USING (br, bc, t)"""


@query("obs", TREND_POLYNOMIAL, BLOCK_YEARS, trend_sql("y", "br, bc"), USED_YEARS)
def r29_trend_polynomial(obs):
    """R29 as a whole: blocks of cells as medians of each time slice (a month here), yearly median, deviation and count, a line and the
    NMAD of its residuals, which years are used, the first and last of them, and the cubic through the used years (of a lower degree
    where they are too few) at each."""
    blocks = obs.groupBy(F.floor(F.col("r") / 2).cast("int").alias("br"), F.floor(F.col("c") / 2).cast("int").alias("bc"), "yr", F.trunc("d", "month").alias("m")).agg(F.median("z").alias("z"))
    keys = ["br", "bc"]
    y = blocks.groupBy(*keys, "yr", (F.col("yr") - 1998).alias("t")).agg(F.median("z").alias("z"), F.stddev_pop("z").alias("std"), F.count("*").alias("n"))
    fit = G.linear_trend(y.select(*keys, "t", "z"), keys, "t", "z").where("n >= 2").select(*keys, "slope", "intercept", "nmad")
    off = F.abs(F.round(F.col("z") - F.col("slope") * F.col("t") - F.col("intercept"), 9)) > F.greatest(F.lit(FAR), 3 * F.round("nmad", 9))
    u = y.join(fit, keys).withColumn("used", (F.col("yr") >= FIRST_YEAR) & (F.col("n") >= LEAST_COUNT) & ~(off & (F.col("n") < THIN)))
    u = files.stored(u.select(*keys, "yr", "t", "z", "std", "n", "nmad", "used"), "years")
    used = u.where("used")
    ends = used.groupBy(*keys).agg(F.min("yr").alias("first_yr"), F.max("yr").alias("last_yr"))
    cubic = polynomial_fit(used, keys, "t", "z", 3, scale=3.0).drop("n").join(ends, keys)
    at = F.when(F.col("used"), C.polynomial(F.reverse("coefficients"), F.col("t").cast("double")))
    rows = u.join(cubic, keys, "left")
    return rows.select(*keys, "yr", F.round("z", 6).alias("z"), F.round("std", 6).alias("std"), "n", F.round("nmad", 4).alias("nmad"), "used", "first_yr", "last_yr", (F.round(at + OFFSET, 5) - OFFSET).alias("fitted"))


GAPS = """, y AS (SELECT r, c, yr - 1995 AS t, median(z) AS z FROM obs GROUP BY r, c, yr), f AS (SELECT r, c, regr_slope(z, t) AS b, regr_intercept(z, t) AS a FROM y WHERE t < 5 GROUP BY r, c HAVING count(*) >= 3),
e AS (SELECT size, r // size AS gr, c // size AS gc, avg(z - b*t - a) AS e FROM y JOIN f USING (r, c), (VALUES (1), (2), (4), (8)) v(size) WHERE t = 5 AND (r // size + c // size) % 2 = 0 GROUP BY ALL)
SELECT size, round(1.4826::DOUBLE*median(abs(e-m)), 6) AS nmad, count(*) AS n FROM (SELECT *, median(e) OVER (PARTITION BY size) AS m FROM e) GROUP BY size"""


@query("obs", GAPS)
def r40_square_gaps(obs):
    """A board of square gaps in the last year is filled from the trend of the years before; the spread of the gaps' mean error by size."""
    y = obs.groupBy("r", "c", (F.col("yr") - 1995).alias("t")).agg(F.median("z").alias("z"))
    fit = y.where("t < 5").groupBy("r", "c").agg(F.regr_slope("z", "t").alias("b"), F.regr_intercept("z", "t").alias("a"), F.count("*").alias("n")).where("n >= 3").drop("n")
    e = y.where("t = 5").join(fit, ["r", "c"]).withColumn("size", F.explode(F.array(*map(F.lit, (1, 2, 4, 8)))))
    e = e.withColumn("gr", F.floor(F.col("r") / F.col("size"))).withColumn("gc", F.floor(F.col("c") / F.col("size"))).where((F.col("gr") + F.col("gc")) % 2 == 0)
    gaps = e.groupBy("size", "gr", "gc").agg(F.avg(F.col("z") - F.col("b") * F.col("t") - F.col("a")).alias("e"))
    return G.robust_stack(gaps, ["size"], "e").select("size", F.round("nmad", 6).alias("nmad"), "n")


#: The gap experiment: cells of a chunk's side, sizes of gaps, cells kept from the rim and between gaps, and how many gaps there are.
CHUNK, SIZES = 20, (2, 3, 5)
LAYOUTS = {size: gaps.gap_starts(CHUNK, size, edge=1, inner=2, smallest=2, most=20, least=4) for size in SIZES}


def robust_sql(to: str, years: str) -> str:
    """CTEs that end in ``to``: the slope and NMAD of every cell's robust trend over the flagged years that ``years`` accepts."""
    best = f"list_reduce(list_prepend({{'k': round(f.nmad, 6), 'b': f.b}}, l), lambda a, x: CASE WHEN a['k'] > {ROUGH} AND x['k'] < a['k'] THEN x ELSE a END)"
    return (
        f"{to}y AS (SELECT r, c, t, z FROM (SELECT *, count_if(flag <> 3) OVER (PARTITION BY r, c) AS good FROM q WHERE {years}) WHERE flag <> 3 OR good < 3), {trend_sql(to + 'y', 'r, c', to + 'f')}, "
        f"{to}v AS (SELECT a.*, b.t AS o FROM {to}y a JOIN {to}y b USING (r, c) WHERE a.t <> b.t), {trend_sql(to + 'v', 'r, c, o', to + 'g')}, "
        f"{to} AS (SELECT r, c, s['b'] AS b, s['k'] AS nmad FROM (SELECT r, c, {best} AS s FROM {to}f f LEFT JOIN (SELECT r, c, list({{'k': round(nmad, 6), 'b': b}} ORDER BY o) AS l FROM {to}g GROUP BY r, c) USING (r, c)))"
    )


YEARS_300 = "q AS (SELECT r, c, yr - 1995 AS t, median(z)/300 AS z, CAST(1 + count(*) % 4 AS INT) AS flag FROM obs GROUP BY r, c, yr)"
STARTS = ", ".join(f"({size}, {a}, {b})" for size, (rows, cols) in LAYOUTS.items() for a in rows for b in cols)
GAP_RAW = f"""SELECT size, r - r % {CHUNK} + r0 AS gr, c - c % {CHUNK} + c0 AS gc, r, c, CAST(least(r % {CHUNK} - r0 + 1, r0 + size - r % {CHUNK}, c % {CHUNK} - c0 + 1, c0 + size - c % {CHUNK}) AS INT) AS d, round(w.b - a.b + {OFFSET}::DOUBLE, 5) - {OFFSET}::DOUBLE AS raw, round(a.nmad, 6) AS nmad
FROM ref JOIN (VALUES {STARTS}) v(size, r0, c0) ON r % {CHUNK} BETWEEN r0 AND r0 + size - 1 AND c % {CHUNK} BETWEEN c0 AND c0 + size - 1 LEFT JOIN a USING (r, c) LEFT JOIN w USING (r, c)"""


def trends_with_and_without(obs, ref):
    """Every cell's robust trend over all years (b, nmad) and over those before the last (w), and whether it is on ice."""
    q = files.stored(flagged(obs, 300.0), "yearly")
    before = q.join(F.broadcast(q.agg(F.max("t").alias("last"))), F.col("t") < F.col("last")).drop("last")  # one row
    slope = lambda years, name: robust_trend(by_flags(years), ["r", "c"], "t", "z", ROUGH).select("r", "c", F.col("slope").alias(name), "nmad")
    both = slope(q, "b").join(slope(before, "w").drop("nmad"), ["r", "c"], "full")
    return ref.select("r", "c", (~F.col("stable") & ~F.col("zone").startswith("Brand#5")).alias("ice")).join(both, ["r", "c"], "left")


@query("ref obs", GAP_RAW, YEARS_300, robust_sql("a", "true"), robust_sql("w", "t < (SELECT max(t) FROM q)"))
def r40_gap_cells(ref, obs):
    """The cells of the experiment's square gaps in every chunk, their distance to the edge, and how far the trend without the last
    year is off the trend with it."""
    got = gaps.gap_cells(trends_with_and_without(obs, ref), LAYOUTS, CHUNK)
    return got.select("size", "gr", "gc", "r", "c", "d", (F.round(F.col("w") - F.col("b") + OFFSET, 5) - OFFSET).alias("raw"), F.round("nmad", 6).alias("nmad"))


@query("ref obs", None)
def r40_area_curve(ref, obs):
    """Gaps filled from the years before and corrected across their edges: the spread of their mean errors by area."""
    return gaps.area_curve(gaps.gap_errors(trends_with_and_without(obs, ref), LAYOUTS, CHUNK))


@query("ref obs", None)
def r40_distance_curve(ref, obs):
    """The spread of the same errors, cell by cell, by the distance to the gap's edge."""
    return gaps.distance_curve(gaps.gap_errors(trends_with_and_without(obs, ref), LAYOUTS, CHUNK))


def training_set(obs, ref):
    """Cells inside labelled polygons with what a classifier sees."""
    labelled = S.in_polygon(ref, RINGS).where("name is not null")
    seen = obs.groupBy("r", "c").agg(F.median("z").alias("z"), F.count("*").alias("n"), F.avg("proba").alias("p"))
    return labelled.join(seen, ["r", "c"], "left").select("r", "c", "name", "slope", "ref_z", "z", "n", "p")


@query("obs ref", "SELECT r, c, name, slope, round(z, 9) AS z, n, round(p, 6) AS p FROM (SELECT r, c, min(name) AS name FROM i GROUP BY r, c) JOIN ref USING (r, c) LEFT JOIN (SELECT r, c, median(z) AS z, count(*) AS n, avg(proba) AS p FROM obs GROUP BY r, c) USING (r, c)", EDGES, INSIDE)
def r34_training_set(obs, ref):
    """Pixels of labelled polygons with their attributes; a cell in two polygons has the first."""
    return training_set(obs, ref).select("r", "c", "name", "slope", F.round("z", 9).alias("z"), "n", F.round("p", 6).alias("p"))


MATCHED = """, t AS (SELECT r, c, name, slope, round(z, 9) AS z, n, round(p, 6) AS p FROM (SELECT r, c, min(name) AS name FROM i GROUP BY r, c) JOIN ref USING (r, c) LEFT JOIN (SELECT r, c, median(z) AS z, count(*) AS n, avg(proba) AS p FROM obs GROUP BY r, c) USING (r, c)),
u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY name, slope, z, n, p ORDER BY r, c) = 1), k AS (SELECT *, slope // 10 AS bin, row_number() OVER (PARTITION BY name, slope // 10 ORDER BY (r * 7919 + c * 104729) % 10007, r, c) AS k FROM u),
m AS (SELECT bin, count(*) AS most FROM u, (SELECT DISTINCT bin FROM k) b WHERE name = 'north' AND slope // 10 = bin GROUP BY bin) SELECT r, c, name, slope, z, n, p FROM k LEFT JOIN m USING (bin) WHERE name = 'north' OR k <= coalesce(most, 0)"""


@query("obs ref", MATCHED, EDGES, INSIDE)
def r34_matched_training_set(obs, ref):
    """Cells whose attributes repeat within a patch count once; of the other patch's cells as many are taken in each bin of
    slope as the first has there, by the order of a hash."""
    t = training_set(obs, ref).select("r", "c", "name", "slope", F.round("z", 9).alias("z"), "n", F.round("p", 6).alias("p"))
    once = t.groupBy("name", "slope", "z", "n", "p").agg(F.min(F.struct("r", "c")).alias("at")).select("at.r", "at.c", "name", "slope", "z", "n", "p")
    once = files.stored(once.withColumn("bin", F.floor(F.col("slope") / 10).cast("int")), "training")
    most = once.where("name = 'north'").groupBy("bin").agg(F.count("*").alias("most"))
    place = F.row_number().over(W.partitionBy("name", "bin").orderBy((F.col("r") * 7919 + F.col("c") * 104729) % 10007, "r", "c"))
    kept = once.withColumn("k", place).join(F.broadcast(most), "bin", "left").where((F.col("name") == "north") | (F.col("k") <= F.coalesce("most", F.lit(0))))  # a row per bin
    return kept.select("r", "c", "name", "slope", "z", "n", "p")


FEATURES = ["slope", "ref_z", "z", "n", "p"]


def assembled(df, features=FEATURES):
    """Features with missing values at -1 and a flag for each, so that a split can take the missing ones out."""
    from pyspark.ml.feature import VectorAssembler

    filled = df.select("*", *(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"f_{c}") for c in features), *(F.col(c).isNull().cast("double").alias(f"m_{c}") for c in features))
    return VectorAssembler(inputCols=[f"{k}_{c}" for k in "fm" for c in features], outputCol="features").transform(filled)


@query("obs ref", None)
def r35_gap_classifier(obs, ref):
    """Boosted trees told which polygon a cell belongs to, then every cell's probability as a byte (255 near missing values)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    labelled = files.stored(training_set(obs, ref).withColumn("label", (F.col("name") == "north").cast("double")), "training")
    model = GBTClassifier(maxIter=10, maxDepth=3, seed=0).fit(assembled(labelled))
    seen = obs.groupBy("r", "c").agg(F.median("z").alias("z"), F.count("*").alias("n"), F.avg("proba").alias("p"))
    cells = model.transform(assembled(ref.join(seen, ["r", "c"], "left").drop("name")))
    p = vector_to_array("probability")[1]
    return cells.select("r", "c", F.when(F.col("z").isNull(), 255).otherwise(F.least(F.lit(254), (p * 255).cast("int"))).alias("proba"))


MODEL = """, e AS (SELECT r, c, slope, z - 480 AS e FROM obs JOIN ref USING (r, c)), b AS (SELECT CAST(floor(slope/10.0) AS INT) AS bin, 1.4826::DOUBLE*median(abs(e-m)) AS s, avg(slope) AS x FROM (SELECT *, median(e) OVER (PARTITION BY CAST(floor(slope/10.0) AS INT)) AS m FROM e) GROUP BY 1 HAVING count(*) >= 5),
g AS (SELECT x AS x0, s AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(s) OVER (ORDER BY x) AS y1, lag(x) OVER (ORDER BY x) IS NULL AS f, lead(x, 2) OVER (ORDER BY x) IS NULL AS l FROM b),
p AS (SELECT r, c, slope, y0 + (slope-x0)/(x1-x0)*(y1-y0) AS err FROM ref JOIN g ON x1 IS NOT NULL AND (f OR slope >= x0) AND (l OR slope < x1)), k AS (SELECT 1.4826::DOUBLE*median(abs(q-m)) AS k FROM (SELECT q, median(q) OVER () AS m FROM (SELECT e/err AS q FROM e JOIN p USING (r, c))))
SELECT r, c, round(err*k, 5) AS err FROM p, k"""


@query("pts", None)
def r38_variogram_fit(pts):
    """A spherical model through Dowd's estimates, a few tens of lags."""
    g = replicate_pairs(pts).groupBy(C.uniform_bin("dist", 0, 4.0).alias("bin")).agg(F.count("*").alias("n"), (F.pow(2.198 * F.median("dv"), F.lit(2)) / 2).alias("gamma"))
    lags = g.orderBy("bin").collect()
    fit = V.fit_spherical([4 * r.bin + 2 for r in lags], [r.gamma for r in lags], [r.n for r in lags]) if lags else (0.0, 0.0, 0.0)
    return pts.sparkSession.createDataFrame([tuple(round(x, 6) for x in fit)], "nugget double, sill double, reach double")


@query("pts", None)
def t08_farthest_points(pts):
    """Of all points sixteen that lie far from one another."""
    return V.farthest_points(pts, 16)


@query("pts", None)
def r39_balanced_points(pts):
    """Thirty replicates of twenty-five points whose pair distances are spread evenly."""
    return V.balanced_points(pts, 30, 25, 4.0, 8)


DRAWS = sorted({tuple(sorted((k * 7919 % 4, (k * 7919 % 4 + 1 + k * 104729 % 3) % 4))) for k in range(12)})
RANSAC = f""", y AS (SELECT r, c, yr - 1990 AS t, median(z) AS y FROM obs GROUP BY r, c, yr), k AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY t) AS k, count(*) OVER (PARTITION BY r, c) AS n FROM y),
w AS (SELECT a.r, a.c, a.t AS t0, b.t, b.y, b.k - a.k AS i FROM k a JOIN k b ON a.r = b.r AND a.c = b.c AND b.k BETWEEN a.k AND a.k + 3 WHERE a.k <= a.n - 3),
m AS (SELECT *, median(y) OVER (PARTITION BY r, c, t0) AS m FROM w), l AS (SELECT *, median(abs(y - m)) OVER (PARTITION BY r, c, t0) + 1e-9 AS lim FROM m),
d AS (SELECT l.*, v.i AS vi, v.j AS vj, abs(l.y - a.y - (b.y - a.y) / (b.t - a.t) * (l.t - a.t)) AS off FROM l, (VALUES {', '.join(map(str, DRAWS))}) v(i, j) JOIN l a ON a.r = l.r AND a.c = l.c AND a.t0 = l.t0 AND a.i = v.i JOIN l b ON b.r = l.r AND b.c = l.c AND b.t0 = l.t0 AND b.i = v.j),
s AS (SELECT r, c, t0, vi, vj, count(*) AS n, round(sum(off), 9) AS e, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept FROM d WHERE off <= lim GROUP BY r, c, t0, vi, vj HAVING count(*) >= 2)
SELECT r, c, t0::DOUBLE AS t0, round(slope, 8) AS slope, round(intercept, 7) AS intercept, CAST(n AS INT) AS n_in FROM (SELECT *, row_number() OVER (PARTITION BY r, c, t0 ORDER BY n DESC, e, vi * 4 + vj) AS k FROM s) WHERE k = 1"""


@query("obs", RANSAC)
def r30_rolling_ransac(obs):
    """Lines by seeded draws in sliding windows of four years of every cell."""
    y = G.by_cell(obs.select("r", "c", (F.col("yr") - 1990).alias("t"), "z")).groupBy("r", "c", "t").agg(F.median("z").alias("y"))
    got = V.rolling_ransac(y, ["r", "c"], "t", "y")
    return got.select("r", "c", "t0", F.round("slope", 8).alias("slope"), F.round("intercept", 7).alias("intercept"), "n_in")


def octagons(dems, grow: float, shift: float):
    """A ring for every supplier around a place of its own."""
    x, y = F.col("dem_id") % 36 + 2.3 + shift, F.floor(F.col("dem_id") / 36.0) * 3 + 4.2
    size = (F.col("n_cmp") % 5 * 0.5 + 2) * grow
    corner = [F.struct((x + size * float(np.cos(a))).alias("x"), (y + size * float(np.sin(a))).alias("y")) for a in np.arange(8) * np.pi / 4]
    return dems.select("dem_id", F.array(*corner).alias("ring"))


@query("dems", None)
def r26_outline_morph(dems):
    """The area inside every outline at five shares of the time between two dates."""
    got = O.morphed(octagons(dems, 1.0, 0.0), octagons(dems, 1.6, 0.7), [0.0, 0.25, 0.5, 0.75, 1.0], "dem_id", (-50, 100))
    return got.groupBy("dem_id", "share").agg(F.count("*").alias("cells"))


@query("obs", None)
def r28_block_polynomials(obs):
    """A robust plane and sampled polynomials in time of degrees 1 to 4 by block, with their scores and the plane's slopes."""
    rows = obs.select((F.floor(F.col("r") / TILE)).cast("int").alias("tr"), F.floor(F.col("c") / TILE).cast("int").alias("tc"), F.col("c").alias("x"), F.col("r").alias("y"), (F.col("yr") - 1998).alias("t"), "z")
    got = V.block_polynomials(rows, ["tr", "tc"], (1, 2, 3, 4), origin=1998.0)
    return got.select("tr", "tc", "degree", *(F.get("coefficients", F.lit(i)).alias(f"c{i}") for i in range(5)), "nmad", "score", "n_in", "n", "slope_x", "slope_y")


@query("obs ref", None)
def r09_joint_planes(obs, ref):
    """Planes of all strips of every year at once, in one minimisation a year."""
    year = obs.select("yr", F.col("dem_id").alias("dem"), F.col("c").alias("x"), F.col("r").alias("y"), (F.col("z") / 20).alias("z"))
    stable = ref.where("stable").select(F.col("c").alias("x"), F.col("r").alias("y"), (F.col("ref_z") / 40).alias("ref"))
    return registration.joint_planes(year.join(stable, ["x", "y"], "left"))


def shifted_strips(obs, ref, dems):
    """A rough surface over the reference's cells, and strips that lie on it shifted and raised by their own amounts, with the
    observations as noise."""
    rise = lambda x, y: 40 * F.sin(x / 4) + 30 * F.cos(y / 5)
    surface = ref.select("r", "c", (rise(F.col("c"), F.col("r")) + F.col("ref_z") / 5000).alias("z"))
    at = obs.join(dems.select("dem_id", (F.col("pa") * 150).alias("sx"), (F.col("pb") * 250).alias("sy"), F.col("pc").alias("sz")), "dem_id")
    z = rise(F.col("c") + F.col("sx"), F.col("r") + F.col("sy")) + F.col("sz") + F.col("z") / 2000
    return surface, at.select(F.col("dem_id").alias("dem"), F.col("c").alias("x"), F.col("r").alias("y"), z.alias("z"), "sx", "sy")


@query("obs ref dems", None)
def r10_rigid_shifts(obs, ref, dems):
    """Shifts of all strips to the reference in one plan: whole cells first, then by slope and aspect until small."""
    surface, strips = shifted_strips(obs, ref, dems)
    got = registration.rigid_shifts(strips, surface)
    return got.select("dem", *(F.round(c, 4).alias(c) for c in ("dx", "dy", "dz")), "n", *(F.round(c, 4).alias(c) for c in ("before", "after")))


@query("series ref", None)
def r11_track_shifts(series, ref):
    """Tracks of height points over the same surface, shifted to it by the same descent; a track is a user's points of a type."""
    surface = ref.select("r", "c", (40 * F.sin(F.col("c") / 4) + 30 * F.cos(F.col("r") / 5)).alias("z"))
    size = ref.agg(F.greatest(F.max("r") - 4, F.lit(1)).alias("rows"))  # one row
    p = series.join(F.broadcast(size)).select(F.col("track").alias("dem"), (F.col("event_id") * 13 % 3600 / 100.0 + 2).alias("x"), (F.col("event_id") * 7919 % (F.col("rows") * 100) / 100.0 + 2).alias("y"), "h")
    off = F.length("dem") % 4 * 0.4 - 0.6
    z = 40 * F.sin((F.col("x") + off) / 4) + 30 * F.cos((F.col("y") - off) / 5) + F.col("h") / 100
    got = registration.rigid_shifts(p.select("dem", "x", "y", z.alias("z")), surface)
    return got.select(F.col("dem").alias("track"), *(F.round(c, 4).alias(c) for c in ("dx", "dy", "dz")), "n", *(F.round(c, 4).alias(c) for c in ("before", "after")))


REPEATS = 20


@query("obs ref", None)
def r35_feature_importance(obs, ref):
    """The classifier's accuracy on a held-out quarter, and by how much it falls when a feature is shuffled, mean and deviation of
    twenty shuffles. All shuffles are one frame, keyed by feature and repeat, and scored in one pass."""
    labelled = files.stored(training_set(obs, ref).withColumn("label", (F.col("name") == "north").cast("double")).drop("name"), "training")
    quarter = F.pmod(F.xxhash64(F.lit(0), "r", "c"), F.lit(4)) == 0
    return importance(labelled.where(~quarter), labelled.where(quarter), ["r", "c"], FEATURES)


def importance(train, test, keys: list[str], features: list[str], repeats: int = REPEATS):
    """(feature, accuracy, mean, std): the accuracy of boosted trees on ``test`` and what each feature's shuffles take from it."""
    from pyspark.ml.classification import GBTClassifier

    model = GBTClassifier(maxIter=10, maxDepth=3, seed=0).fit(assembled(train, features))
    test = files.stored(test.withColumn("k", F.row_number().over(W.partitionBy(F.pmod(F.xxhash64(*keys), F.lit(1))).orderBy(*keys))), "held_out")  # labelled cells: few
    each = test.withColumn("feature", F.explode(F.array(*map(F.lit, ["", *features])))).withColumn("turn", F.explode(F.sequence(F.lit(1), F.when(F.col("feature") == "", 1).otherwise(repeats))))
    order = W.partitionBy("feature", "turn").orderBy(F.xxhash64(F.lit(7), "feature", "turn", *keys), *keys)
    moved = each.withColumn("place", F.row_number().over(order))
    other = moved.select("feature", "turn", F.col("place").alias("k"), *(F.col(f).alias(f"o_{f}") for f in features))
    shuffled = each.join(other, ["feature", "turn", "k"])
    shuffled = shuffled.select("feature", "turn", "label", *(F.when(F.col("feature") == f, F.col(f"o_{f}")).otherwise(F.col(f)).alias(f) for f in features))
    right = model.transform(assembled(shuffled, features)).groupBy("feature", "turn").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a"))
    right = files.stored(right, "scores")  # a row per shuffle
    base = right.where("feature = ''").select(F.col("a").alias("accuracy"))
    got = right.where("feature <> ''").join(F.broadcast(base)).groupBy("feature", "accuracy").agg(F.avg(F.col("accuracy") - F.col("a")).alias("mean"), F.stddev_pop(F.col("accuracy") - F.col("a")).alias("std"))
    return got.select("feature", "accuracy", "mean", "std")


CUBE = """, t AS (SELECT DISTINCT r // 8 AS tr, c // 8 AS tc, yr FROM obs), y AS (SELECT r, c, yr, median(z) AS z FROM obs GROUP BY r, c, yr)
SELECT CAST(tr * 8 + i AS INT) AS r, CAST(tc * 8 + j AS INT) AS c, t.yr, round(z, 9) AS z FROM t, range(8) a(i), range(8) b(j) LEFT JOIN y ON y.r = tr * 8 + i AND y.c = tc * 8 + j AND y.yr = t.yr"""


@query("obs", CUBE)
def r27_resumed_cube(obs):
    """A dense cube by chunks; the first run sees the years to 1996, the second all, so stale chunks are made again, a third
    finds nothing to do."""
    path = files.fresh_path(obs.sparkSession, "cube")
    for part in (obs.where("yr <= 1996"), obs, obs):
        done = cubes.refresh_cube(part, path)
    if done:
        raise RuntimeError("a finished cube was made again")
    return obs.sparkSession.read.parquet(f"{path}/cube").select("r", "c", "yr", F.round("z", 9).alias("z"))


EDGE = """, y AS (SELECT r, c, yr, median(z) / 300 AS z FROM obs GROUP BY r, c, yr), f AS (SELECT r, c, regr_slope(z, yr) AS b, regr_intercept(z, yr) AS a FROM y GROUP BY r, c HAVING count(*) >= 2 AND regr_sxx(z, yr) > 0),
e AS (SELECT r, c, z - b*yr - a AS e FROM y JOIN f USING (r, c)), m AS (SELECT r, c, median(e) AS m FROM e GROUP BY r, c), s AS (SELECT r, c, 1.4826::DOUBLE*median(abs(e-m)) AS nmad FROM e JOIN m USING (r, c) GROUP BY r, c),
g AS (SELECT r, c, (r, c) IN (SELECT (r, c) FROM y WHERE yr = (SELECT max(yr) FROM y)) AS valid, b, nmad FROM ref LEFT JOIN f USING (r, c) LEFT JOIN s USING (r, c) WHERE NOT stable AND NOT zone LIKE 'Brand#5%'),
p AS (SELECT v.r, v.c, i.r AS ri, i.c AS ci, v.b - i.b AS diff, greatest(v.nmad, i.nmad) AS nmad, row_number() OVER (PARTITION BY v.r, v.c ORDER BY (v.r-i.r)*(v.r-i.r) + (v.c-i.c)*(v.c-i.c), i.r, i.c) AS k
  FROM g v JOIN g i ON v.valid AND NOT i.valid AND abs(v.r-i.r) <= 1 AND abs(v.c-i.c) <= 1),
q AS (SELECT (c + ci) / 2::DOUBLE + 0.5::DOUBLE AS x, (r + ri) / 2::DOUBLE + 0.5::DOUBLE AS y, diff FROM p WHERE k = 1 AND nmad < 2 AND abs(diff) < 0.6)
SELECT median(x) AS x, median(y) AS y, round(median(diff), 7) AS v, count(*) AS n FROM q GROUP BY floor(x / 4), floor(y / 4)"""


def trends_and_gaps(obs, ref):
    """Cells of glaciers (neither stable nor ocean) with their trend, its spread, and whether the last year has a value."""
    y = files.stored(obs.groupBy("r", "c", "yr").agg((F.median("z") / 300).alias("z")), "yearly")
    last = y.join(F.broadcast(y.agg(F.max("yr").alias("yr"))), "yr").select("r", "c", F.lit(True).alias("valid"))  # one row
    fit = G.linear_trend(y, ["r", "c"], "yr", "z").where("slope is not null").select("r", "c", F.col("slope").alias("b"), "nmad")
    ice = ref.where(~F.col("stable") & ~F.col("zone").startswith("Brand#5")).select("r", "c")
    return files.stored(ice.join(last, ["r", "c"], "left").join(fit, ["r", "c"], "left").select("r", "c", F.coalesce("valid", F.lit(False)).alias("valid"), "b", "nmad"), "ice")


def bins_of(g):
    return gaps.edge_bins(g.where("valid"), g.where("not valid").select("r", "c", "b", "nmad"))


@query("obs ref", EDGE)
def r08_edge_bins(obs, ref):
    """What the surface goes through: binned differences of the trend across the last year's gaps."""
    return bins_of(trends_and_gaps(obs, ref)).select("x", "y", F.round("v", 7).alias("v"), "n")


@query("obs ref", None)
def r08_temporal_bias(obs, ref):
    """The trend's bias where the last year is missing: the surface through the differences at the gaps' edges, 0 elsewhere."""
    g = trends_and_gaps(obs, ref)
    at = g.where("not valid").select("r", "c", (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"))
    found = radial_surface(bins_of(g).select("x", "y", "v"), at).select("r", "c", "z")
    return ref.select("r", "c").join(found, ["r", "c"], "left").select("r", "c", F.round(F.coalesce("z", F.lit(0.0)), 7).alias("bias"))


@query("obs", "SELECT r, c, yr, round(median(z), 9) AS z, count(z) AS n FROM obs GROUP BY r, c, yr")
def st_incremental_tiles(obs):
    """Observations arrive in files by year parity; every batch makes only the tile rows it touches again."""
    spark = obs.sparkSession
    source, store, out, check = (files.fresh_path(spark, n) for n in ("arriving", "taken", "tiles", "progress"))
    for part in (0, 1):
        obs.where(F.col("yr") % 2 == part).select("r", "c", "yr", "z").coalesce(2).write.mode("append").parquet(source)
    return stream.refresh(source, "r int, c int, yr int, z double", store, out, check, spark).select("r", "c", "yr", "z", "n")


# --- user functions: the ways in which one enters a plan ---------------------------------------------------

@query("ref", "SELECT r, c, round(ref_z*0.3 + slope*slope*0.01::DOUBLE, 6) AS v FROM ref")
def ud_vectorised(ref):
    """A function over columns, a batch at once."""

    @F.pandas_udf("double")
    def score(z: pd.Series, slope: pd.Series) -> pd.Series:
        return z * 0.3 + slope * slope * 0.01

    return ref.select("r", "c", F.round(score("ref_z", F.col("slope").cast("double")), 6).alias("v"))


ORDERED = ", y AS (SELECT r, c, yr, median(z) AS z FROM obs GROUP BY r, c, yr) SELECT r, c, round(sum(abs(d)), 6) AS path FROM (SELECT r, c, z - lag(z) OVER (PARTITION BY r, c ORDER BY yr) AS d FROM y) GROUP BY r, c"


@query("obs", ORDERED)
def ud_along_axis(obs):
    """A function along the time axis of all cells of a tile at once: a group is a tile, a bounded block of cells, not a cell."""
    y = obs.groupBy("r", "c", "yr").agg(F.median("z").alias("z"))
    y = y.withColumn("tr", F.floor(F.col("r") / TILE)).withColumn("tc", F.floor(F.col("c") / TILE))

    def path(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["r", "c", "yr"])
        step = g.groupby(["r", "c"]).z.diff().abs()
        got = step.groupby([g.r, g.c]).agg(lambda d: round(float(d.sum()), 6) if d.notna().any() else None)
        return got.rename("path").reset_index()

    return y.groupBy("tr", "tc").applyInPandas(path, "r int, c int, path double")


@query("ref", "SELECT r, c, ref_z > 950 AND slope % 2 = 0 AS flag FROM ref")
def ud_map_blocks(ref):
    """A function over Arrow batches with a schema given beforehand."""

    def run(batches):
        for b in batches:
            flag = (b.column("ref_z").to_numpy() > 950) & (b.column("slope").to_numpy() % 2 == 0)
            yield pa.RecordBatch.from_arrays([b.column("r"), b.column("c"), pa.array(flag)], names=["r", "c", "flag"])

    return ref.select("r", "c", "ref_z", "slope").mapInArrow(run, "r int, c int, flag boolean")


@query("obs ref", "SELECT tr, round(a - b, 6) AS d FROM (SELECT r // 8 AS tr, avg(z) AS a FROM obs GROUP BY 1) JOIN (SELECT r // 8 AS tr, avg(ref_z) AS b FROM ref GROUP BY 1) USING (tr)")
def ud_delayed_pairs(obs, ref):
    """A function of two relations' parts with one key, put together afterwards."""
    key = F.floor(F.col("r") / 8).cast("int").alias("tr")

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"tr": pd.Series([], dtype="int32"), "d": pd.Series([], dtype="float64")})
        return pd.DataFrame({"tr": [a.tr.iloc[0]], "d": [round(a.z.mean() - b.ref_z.mean(), 6)]})

    return obs.select(key, "z").groupBy("tr").cogroup(ref.select(key, "ref_z").groupBy("tr")).applyInPandas(both, "tr int, d double")


@query("dems", "SELECT dem_id, upper(region[1:1]) || lower(region[2:]) || '-' || length(region) AS label FROM dems")
def ud_row_expressions(dems):
    """What would be a function of a row is an expression."""
    label = F.concat(F.upper(F.substring("region", 1, 1)), F.lower(F.expr("substring(region, 2)")), F.lit("-"), F.length("region").cast("string"))
    return dems.select("dem_id", label.alias("label"))


@query("ref", "SELECT r, c, round(sqrt((slope*0.5)*(slope*0.5) + 4), 6) AS steep, round(0.1*ref_z + 1, 6) AS high FROM ref")
def ud_closures(ref):
    """Error functions handed around: each takes and gives a column."""
    grown = lambda f, k: lambda c: F.sqrt(f(c) * f(c) + k)
    steep, high = grown(lambda c: F.col(c) * 0.5, 4), lambda c: 0.1 * F.col(c) + 1
    return ref.select("r", "c", F.round(steep("slope"), 6).alias("steep"), F.round(high("ref_z"), 6).alias("high"))


@query("series", "SELECT event_id, round(avg(h) OVER (PARTITION BY track, user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS m FROM series")
def ud_window_function(series):
    """A function over a moving window, here a built-in one."""
    w = W.partitionBy("track", "user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return series.select("event_id", F.round(F.avg("h").over(w), 6).alias("m"))
