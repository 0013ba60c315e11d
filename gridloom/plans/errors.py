"""Error models over several variables, discs of growing area, noise filters by elevation bands, polygons from tables."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.operators import uncertainty as U
from gridloom.operators.quantiles import exact_nmad, exact_quantiles
from gridloom.plans.registry import query
from gridloom.sources import files

# --- A27: discs -------------------------------------------------------------------------------------------

AREAS = U.log_areas(1.0, 250.0)
DISCS = ", ".join(f"({a!r}::DOUBLE, {sum(2 * h + 1 for h in U.half_widths(a)) * 2 - 2 * U.half_widths(a)[0] - 1})" for a in AREAS)
MEANS = f""", d AS (SELECT r, c, avg(z) - ref_z / 2 AS v FROM obs JOIN ref USING (r, c) GROUP BY r, c, ref_z), a(area, size) AS (VALUES {DISCS}),
m AS (SELECT area, x.r, x.c, avg(y.v) AS m FROM a, d x JOIN d y ON abs(x.r - y.r) <= 9 AND abs(x.c - y.c) <= 9 WHERE (x.r - y.r) * (x.r - y.r) + (x.c - y.c) * (x.c - y.c) <= area / pi() + 1e-9 GROUP BY area, size, x.r, x.c HAVING count(*) >= 0.8 * size)
SELECT round(area, 6) AS area, round(1.4826::DOUBLE * median(abs(m - mid)), 6) AS nmad, count(*) AS n FROM (SELECT *, median(m) OVER (PARTITION BY area) AS mid FROM m) GROUP BY area"""


@query("obs ref", MEANS)
def a27_patch_method(obs, ref):
    """Means over discs of fifteen areas at equal steps of their logarithm, around every cell; their spread by area."""
    d = obs.groupBy("r", "c").agg(F.avg("z").alias("z")).join(ref.select("r", "c", "ref_z").distinct(), ["r", "c"]).select("r", "c", (F.col("z") - F.col("ref_z") / 2).alias("v"))
    means = files.stored(U.disc_means(d, "v", AREAS).select("area", "mean"), "discs")
    return exact_nmad(means, ["area"], "mean").select(F.round("area", 6).alias("area"), F.round("nmad", 6).alias("nmad"), "n")


# --- A8, R37: bins with quantile edges and the error model ----------------------------------------------------

PROBS = ", ".join(f"quantile_cont({{0}}, {i / 9!r})" for i in range(10))
BINS = f"""e AS (SELECT r, c, slope, ref_z, z / 100 - ref_z / 180 AS e FROM obs JOIN ref USING (r, c)),
q AS (SELECT list_sort(list_distinct([{PROBS.format('slope')}])) AS s, list_sort(list_distinct([{PROBS.format('ref_z')}])) AS z FROM e),
k AS (SELECT e.*, least(len(list_filter(s[2:len(s) - 1], lambda x: x <= slope)), len(s) - 2) AS i, least(len(list_filter(q.z[2:len(q.z) - 1], lambda x: x <= ref_z)), len(q.z) - 2) AS j FROM e, q),
g AS (SELECT CASE WHEN a THEN i END AS b0, CASE WHEN b THEN j END AS b1, e FROM k, (VALUES (true, false), (false, true), (true, true)) v(a, b)),
n AS (SELECT b0, b1, count(*) AS n, 1.4826::DOUBLE * median(abs(e - m)) AS nmad FROM (SELECT *, median(e) OVER (PARTITION BY b0, b1) AS m FROM g) GROUP BY b0, b1)"""


def residuals(obs, ref):
    return obs.join(ref.select("r", "c", "slope", "ref_z"), ["r", "c"]).select(F.col("slope").cast("double").alias("slope"), "ref_z", (F.col("z") / 100 - F.col("ref_z") / 180).alias("e"))


@query("obs ref", "SELECT CAST(b0 AS INT) AS b0, CAST(b1 AS INT) AS b1, n, round(nmad, 7) AS nmad FROM n", BINS)
def a08_quantile_bins(obs, ref):
    """Count and spread by bins between quantiles, for each variable and both together."""
    e = files.stored(residuals(obs, ref), "residuals")
    got = U.binned_spread(e, "e", U.quantile_edges(e, ["slope", "ref_z"]))
    return got.select(F.col("b0").cast("int").alias("b0"), F.col("b1").cast("int").alias("b1"), "n", F.round("nmad", 7).alias("nmad"))


def corner(x: str, mids: str) -> str:
    """Place (from 0) and share of a value between the middles of bins."""
    i = f"least(len(list_filter({mids}[2:], lambda m: m <= {x})), greatest(len({mids}) - 2, 0))"
    return f"{i} AS {x}_i, CASE WHEN len({mids}) > 1 THEN greatest(0.0, least(1.0, ({x} - {mids}[{i} + 1]) / ({mids}[{i} + 2] - {mids}[{i} + 1]))) ELSE 0.0 END AS {x}_f"


MODEL = f""", mids AS (SELECT list_transform(range(1, len(s)), lambda i: (s[i] + s[i + 1]) / 2) AS ms, list_transform(range(1, len(z)), lambda i: (z[i] + z[i + 1]) / 2) AS mz FROM q),
every AS (SELECT unnest(range(len(ms))) AS b0, mz FROM mids), grid AS (SELECT b0, unnest(range(len(mz))) AS b1 FROM every), good AS (SELECT * FROM n WHERE b0 IS NOT NULL AND b1 IS NOT NULL AND n >= 5),
f AS (SELECT grid.b0, grid.b1, arg_min(nmad, ((grid.b0 - good.b0) * (grid.b0 - good.b0) + (grid.b1 - good.b1) * (grid.b1 - good.b1), good.b0, good.b1)) AS v FROM grid, good GROUP BY grid.b0, grid.b1),
p AS (SELECT r, c, {corner('slope', 'ms')}, {corner('ref_z', 'mz')}, ms, mz FROM ref, mids),
v AS (SELECT p.r, p.c, (1 - slope_f) * (1 - ref_z_f) * a.v + slope_f * (1 - ref_z_f) * b.v + (1 - slope_f) * ref_z_f * c.v + slope_f * ref_z_f * d.v AS err FROM p JOIN f a ON a.b0 = slope_i AND a.b1 = ref_z_i JOIN f b ON b.b0 = least(slope_i + 1, len(ms) - 1) AND b.b1 = ref_z_i
  JOIN f c ON c.b0 = slope_i AND c.b1 = least(ref_z_i + 1, len(mz) - 1) JOIN f d ON d.b0 = least(slope_i + 1, len(ms) - 1) AND d.b1 = least(ref_z_i + 1, len(mz) - 1)),
std AS (SELECT e / err AS z FROM e JOIN v USING (r, c)), one AS (SELECT 1.4826::DOUBLE * median(abs(z - m)) AS k FROM (SELECT z, median(z) OVER () AS m FROM std)),
two AS (SELECT 1.4826::DOUBLE * median(abs(z - m)) AS k FROM (SELECT z, median(z) OVER () AS m FROM std, one WHERE abs(z) <= 7 * k))
SELECT r, c, round(err * k, 6) AS err FROM v, two"""


@query("obs ref", MODEL, BINS)
def r37_error_model(obs, ref):
    """Spread of residuals by bins of slope and elevation, interpolated over the bins' corners, standardised in two steps."""
    at = ref.select("r", "c", F.col("slope").cast("double").alias("slope"), "ref_z")
    return U.error_model(residuals(obs, ref), at, "e", ["slope", "ref_z"]).select("r", "c", F.round("err", 6).alias("err"))


# --- R32: noise filter by elevation bands -----------------------------------------------------------------------

#: Bands, years to either side, and thresholds of the filter.
BANDS, YEARS_BESIDE, CONSISTENT, NOISE = 5, 1, 0.5, 2.0
NOISY = f""", y AS (SELECT r, c, yr, median(z) / 100 AS z FROM obs GROUP BY r, c, yr), t AS (SELECT zone, min(ref_z) / 100 * 0.9 AS lo, (max(ref_z) / 100 * 1.1 - min(ref_z) / 100 * 0.9) / {BANDS} AS w FROM ref GROUP BY zone),
d AS (SELECT r, c, yr, zone, ref_z / 100 AS x, lo, w, zone LIKE 'Brand#1%' AS ice, greatest(0, least({BANDS}, floor((ref_z / 100 - lo) / w) + 1)) AS band, (z - ref_z / 100) / greatest(1, abs(1990 + slope % 5 - yr)) AS v FROM y JOIN ref USING (r, c) JOIN t USING (zone)),
s AS (SELECT zone, yr, band, lo + (band - 1) * w AS x, median(v) AS v FROM d GROUP BY zone, yr, band, lo, w), l AS (SELECT zone, yr, list(x ORDER BY x) AS xs, list(v ORDER BY x) AS vs FROM s GROUP BY zone, yr),
i AS (SELECT d.*, xs, vs, greatest(1, least(len(xs) - 1, len(list_filter(xs, lambda q: q <= x)))) AS k FROM d JOIN l USING (zone, yr)),
f AS (SELECT r, c, yr, zone, ice, v, CASE WHEN len(xs) > 1 THEN vs[k] + (x - xs[k]) / (xs[k + 1] - xs[k]) * (vs[k + 1] - vs[k]) ELSE vs[1] END AS ideal FROM i),
n AS (SELECT zone, yr, {NOISE} * median(abs(v - ideal)) AS noise FROM f GROUP BY zone, yr),
w AS (SELECT r, c, yr, median(v) OVER (PARTITION BY r, c ORDER BY yr RANGE BETWEEN {YEARS_BESIDE} PRECEDING AND {YEARS_BESIDE + 1} FOLLOWING) AS near FROM f)
SELECT r, c, yr, ice AND NOT (abs(v - ideal) < noise OR abs(v - near) < {CONSISTENT}) AS invalid FROM f JOIN n USING (zone, yr) JOIN w USING (r, c, yr)"""


@query("obs ref", NOISY)
def r32_noise_filter(obs, ref):
    """A yearly rate of change is invalid inside the outlines if it is as far from the ideal as twice the year's median deviation,
    and 0.5 or more from the median of the years -1 to +2. The ideal is a line between the medians of elevation bands, at their
    lower ends, extended beyond the first and last. Every zone is a glacier of its own; outside nothing is invalid."""
    y = obs.groupBy("r", "c", "yr").agg((F.median("z") / 100).alias("z"))
    ends = ref.groupBy("zone").agg((F.min("ref_z") / 100 * 0.9).alias("lo"), ((F.max("ref_z") / 100 * 1.1 - F.min("ref_z") / 100 * 0.9) / BANDS).alias("w"))
    cells = ref.select("r", "c", "zone", (F.col("ref_z") / 100).alias("x"), (F.col("slope") % 5 + 1990).alias("ref_yr")).join(ends, "zone")
    band = F.greatest(F.lit(0), F.least(F.lit(BANDS), F.floor((F.col("x") - F.col("lo")) / F.col("w")) + 1)).cast("int")
    rate = (F.col("z") - F.col("x")) / F.greatest(F.lit(1), F.abs(F.col("ref_yr") - F.col("yr")))
    d = files.stored(y.join(cells, ["r", "c"]).select("r", "c", "yr", "zone", "x", "lo", "w", band.alias("band"), rate.alias("v")), "rates")
    middle = exact_quantiles(d, ["zone", "yr", "band", "lo", "w"], "v", {"v": 0.5})
    middle = middle.select("zone", "yr", F.struct((F.col("lo") + (F.col("band") - 1) * F.col("w")).alias("x"), "v").alias("p"))
    lines = middle.groupBy("zone", "yr").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # a point a band
    f = d.join(lines, ["zone", "yr"])
    n = F.size("ps")
    k = F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter("ps", lambda p: p["x"] <= F.col("x")))))
    a, b = F.element_at("ps", k), F.element_at("ps", F.least(k + 1, n))
    ideal = F.when(n > 1, a["v"] + F.try_divide(F.col("x") - a["x"], b["x"] - a["x"]) * (b["v"] - a["v"])).otherwise(F.element_at("ps", 1)["v"])
    f = files.stored(f.select("r", "c", "yr", "zone", "v", F.abs(F.col("v") - ideal).alias("off")), "ideal")
    noise = exact_quantiles(f, ["zone", "yr"], "off", {"m": 0.5}).select("zone", "yr", (F.col("m") * NOISE).alias("noise"))
    near = F.percentile("v", F.lit(0.5)).over(W.partitionBy("r", "c").orderBy("yr").rangeBetween(-YEARS_BESIDE, YEARS_BESIDE + 1))
    g = f.withColumn("near", near).join(noise, ["zone", "yr"])
    fine = (F.col("off") < F.col("noise")) | (F.abs(F.col("v") - F.col("near")) < CONSISTENT)
    return g.select("r", "c", "yr", (F.col("zone").startswith("Brand#1") & ~fine).alias("invalid"))


# --- R18, J4: polygons from a table -------------------------------------------------------------------------------

#: A strip's outline: a box without its upper left corner; strips of more than five columns have a hole of three corners.
OUTLINE = [("x0", "y0"), ("x1", "y0"), ("x1 - (x1 - x0) * 0.1", "y1"), ("x0 + (x1 - x0) * 0.4", "y1"), ("x0", "y0 + (y1 - y0) * 0.6")]
HOLE = [("x0 + 2.3", "y0 + 0.3"), ("x0 + 4.1", "y0 + (y1 - y0) * 0.7"), ("x0 + 1.2", "y0 + (y1 - y0) * 0.6")]


def outlines(strips):
    """(strip, ring) of all strips: an outline, and a hole where there is one."""
    ring = lambda corners: F.expr("array(" + ", ".join(f"named_struct('x', cast({x} as double), 'y', cast({y} as double))" for x, y in corners) + ")")
    return strips.select("strip", ring(OUTLINE).alias("ring")).unionByName(strips.where("x1 - x0 > 5").select("strip", ring(HOLE).alias("ring")))


def sides(corners) -> str:
    both = list(zip(corners, corners[1:] + corners[:1], strict=True))
    return " UNION ALL ".join(f"SELECT strip, x0, y0, x1 AS bx, y1 AS by_, ({a[0]})::DOUBLE AS ax, ({a[1]})::DOUBLE AS ay, ({b[0]})::DOUBLE AS cx, ({b[1]})::DOUBLE AS cy FROM strips" + (" WHERE x1 - x0 > 5" if corners is HOLE else "") for a, b in both)


SIDES = f"g AS ({sides(OUTLINE)} UNION ALL {sides(HOLE)})"


@query("ref strips", "SELECT r, c, max(strip) AS strip FROM ref LEFT JOIN k USING (r, c) GROUP BY r, c", SIDES,
       "k AS (SELECT r, c, strip FROM g, LATERAL (SELECT unnest(range(CAST(floor(y0) AS INT), CAST(ceil(by_) AS INT))) AS r) p, LATERAL (SELECT unnest(range(CAST(floor(x0) AS INT), CAST(ceil(bx) AS INT))) AS c) q WHERE (ay > r + 0.5) <> (cy > r + 0.5) AND c + 0.5 < (cx - ax) * (r + 0.5 - ay) / (cy - ay) + ax GROUP BY r, c, strip HAVING count(*) % 2 = 1)")
def r18_rasterise_index(ref, strips):
    """Every strip's outline burned into the grid; where several lie the last one's number stays. Cells come from scan lines."""
    last = U.burned(outlines(strips), ["strip"], (0, 39)).groupBy("r", "c").agg(F.max("strip").alias("strip"))
    return ref.select("r", "c").join(last, ["r", "c"], "left")


@query("pts strips", "SELECT pid, strip FROM pts JOIN g ON x BETWEEN x0 AND bx AND y BETWEEN y0 AND by_ WHERE (ay > y) <> (cy > y) AND x < (cx - ax) * (y - ay) / (cy - ay) + ax GROUP BY pid, strip HAVING count(*) % 2 = 1", SIDES)
def j04_points_in_strips(pts, strips):
    """Points and the strips, of whatever status, whose outline holds them and whose hole doesn't."""
    return U.within(pts.select("pid", "x", "y"), outlines(strips), ["strip"], 4.0).select("pid", "strip")


TITLES = """o AS (SELECT pid, strip, v, median(v) OVER (PARTITION BY seg) AS m, seg FROM (SELECT pid, strip, v / 1000 + (strip % 11 - 5) * 0.3 AS v, seg FROM pts JOIN i USING (pid))),
b AS (SELECT seg, median(v) AS m, 1.4826::DOUBLE * median(abs(v - m)) AS k FROM o GROUP BY seg), f AS (SELECT strip, v < b.m - 1.1 * k OR v > b.m + 1.1 * k AS off FROM o JOIN b USING (seg))"""
INSIDE = "i AS (SELECT pid, strip FROM pts JOIN g ON x BETWEEN x0 AND bx AND y BETWEEN y0 AND by_ WHERE (ay > y) <> (cy > y) AND x < (cx - ax) * (y - ay) / (cy - ay) + ax GROUP BY pid, strip HAVING count(*) % 2 = 1)"
#: Fixed value: good observations from which a title that was seen off stays.
GOOD_ENOUGH = 3


@query("pts strips", f"SELECT strip, count(*) FILTER (off) AS n_out, count(*) FILTER (NOT off) AS n_in, count(*) FILTER (NOT off) < {GOOD_ENOUGH} AS bad, true AS bad_strict FROM f GROUP BY strip HAVING count(*) FILTER (off) >= 1", SIDES, INSIDE, TITLES)
def r45_point_audit(pts, strips):
    """Strips sampled at the points they hold; values off their point's range vote against the strip, three within it
    outvote them, but not in the stricter product."""
    inside = U.within(pts.select("pid", "x", "y", "v", "seg"), outlines(strips), ["strip"], 4.0)
    o = files.stored(inside.select("pid", "strip", "seg", (F.col("v") / 1000 + (F.col("strip") % 11 - 5) * 0.3).alias("v")), "samples")
    limits = exact_nmad(o, ["seg"], "v").select("seg", (F.col("median") - 1.1 * F.col("nmad")).alias("lo"), (F.col("median") + 1.1 * F.col("nmad")).alias("hi"))
    f = o.join(F.broadcast(limits), "seg").withColumn("off", (F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi")))  # five segments
    votes = f.groupBy("strip").agg(F.count(F.when(F.col("off"), 1)).alias("n_out"), F.count(F.when(~F.col("off"), 1)).alias("n_in")).where("n_out >= 1")
    return votes.select("strip", "n_out", "n_in", (F.col("n_in") < GOOD_ENOUGH).alias("bad"), F.lit(True).alias("bad_strict"))
