"""Components, distances, rasterising, resampling, projections, curvature, fills, noise filters and reports."""

from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.operators import grid as G
from gridloom.operators import surface as S
from gridloom.operators.quantiles import exact_nmad
from gridloom.operators.radial import radial_surface
from gridloom.plans.registry import query
from gridloom.sources import files

REACHED = """WITH RECURSIVE {views}, m AS (SELECT r, c, r*1000 + c AS i FROM ref WHERE slope > 30), t(i, r, c, j) AS (SELECT i, r, c, i FROM m UNION SELECT t.i, m.r, m.c, m.i FROM t JOIN m ON abs(m.r-t.r) + abs(m.c-t.c) = 1),
l AS (SELECT i, min(j) AS label FROM t GROUP BY i)"""


def components_sql(tail: str) -> str:
    from gridloom.sources.adapters import SQL

    return REACHED.format(views=SQL["ref"]) + tail


def labelled(ref):
    return S.connected_components(ref.where("slope > 30").select("r", "c"))


@query("ref", None)
def a29_components(ref):
    """Cells of a mask by component (four neighbours), with its size."""
    cells = labelled(ref)
    size = cells.groupBy("label").agg(F.count("*").alias("size"))
    first = cells.groupBy("label").agg(F.min(F.struct("r", "c")).alias("f")).select("label", (F.col("f.r") * 1000 + F.col("f.c")).alias("least"))
    return cells.join(size, "label").join(first, "label").select("r", "c", "least", "size")


@query("ref", None)
def r13_conditioned_mask(ref):
    """Cells to leave out: the tag inverted, grown by three steps of four neighbours, and what is left in components of under
    one hundredth of the largest."""
    return S.conditioned_mask(ref.select("r", "c", F.when(F.col("slope") > 2, 1).otherwise(0).alias("tag")))


@query("ref", "SELECT a.r, a.c, round(sqrt(min((a.r-b.r)*(a.r-b.r) + (a.c-b.c)*(a.c-b.c))), 9) AS d FROM ref a JOIN ref b ON b.slope = 50 GROUP BY a.r, a.c")
def r15_distance_transform(ref):
    """The exact distance of every cell to the nearest one of a mask."""
    return S.distance_transform(ref, F.col("slope") == 50).select("r", "c", F.round("d", 9).alias("d"))


@query("ref", "SELECT DISTINCT a.r, a.c FROM ref a JOIN ref b ON abs(a.r-b.r) + abs(a.c-b.c) = 1 WHERE a.slope > 25 AND b.slope <= 25")
def r16_gap_edges(ref):
    """The cells of a gap that have a neighbour outside it."""
    out = G.neighbours(ref.where("slope <= 25").select("r", "c"), S.FOUR).select("r", "c").distinct()
    return ref.where("slope > 25").select("r", "c").join(out, ["r", "c"], "left_semi")


RINGS = {"north": [(3, 2), (28, 6), (33, 20), (12, 17)], "south": [(8, 22), (36, 25), (30, 45), (20, 33), (5, 44)]}
EDGES = "e(name, x1, y1, x2, y2) AS (VALUES " + ", ".join(f"('{k}', {float(a[0])}::DOUBLE, {float(a[1])}::DOUBLE, {float(b[0])}::DOUBLE, {float(b[1])}::DOUBLE)" for k, ring in RINGS.items() for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) + ")"
INSIDE = "i AS (SELECT r, c, name FROM ref, e WHERE (y1 > r+0.5) <> (y2 > r+0.5) AND c+0.5 < (x2-x1)*(r+0.5-y1)/(y2-y1) + x1 GROUP BY r, c, name HAVING count(*) % 2 = 1)"


@query("ref", "SELECT r, c, min(name) AS name FROM ref LEFT JOIN i USING (r, c) GROUP BY r, c", EDGES, INSIDE)
def r18_rasterise(ref):
    """Polygons as cells, by the cells' centres."""
    return S.in_polygon(ref.select("r", "c"), RINGS)


@query("ref obs", "SELECT y.r, y.c, yr, NOT (yr = 1996 AND name IS NOT NULL) AS ocean FROM (SELECT DISTINCT r, c, yr FROM obs) y LEFT JOIN (SELECT r, c, min(name) AS name FROM i GROUP BY r, c) USING (r, c)", EDGES, INSIDE)
def r19_ocean_mask(ref, obs):
    """Ocean is what lies outside the year's land; a year without geometry is all ocean."""
    land = S.in_polygon(ref.select("r", "c"), RINGS).where("name is not null").select("r", "c", F.lit(1996).alias("yr"), F.lit(False).alias("ocean"))
    return obs.select("r", "c", "yr").distinct().join(land, ["r", "c", "yr"], "left").select("r", "c", "yr", F.coalesce("ocean", F.lit(True)).alias("ocean"))


@query("ref obs", "SELECT r, c, z, yr FROM ref LEFT JOIN (SELECT r, c, arg_max(z, (dem_id, ok, ln)) AS z, arg_max(yr, (dem_id, ok, ln)) AS yr FROM obs WHERE tag GROUP BY r, c) USING (r, c)")
def r21_ordered_overwrite(ref, obs):
    """Sources laid over one another in order, value and year of the last; null where none lies."""
    last = obs.where("tag").groupBy("r", "c").agg(F.max_by(F.struct("z", "yr"), F.struct("dem_id", "ok", "ln")).alias("v"))
    return ref.select("r", "c").join(last, ["r", "c"], "left").select("r", "c", "v.z", "v.yr")


WARPED = """, q AS (SELECT pid, x*0.93::DOUBLE + 0.4::DOUBLE - 0.5::DOUBLE AS u, y*0.97::DOUBLE + 0.3::DOUBLE - 0.5::DOUBLE AS v FROM pts), f AS (SELECT *, CAST(floor(u) AS INT) AS c0, CAST(floor(v) AS INT) AS r0, u - floor(u) AS fx, v - floor(v) AS fy FROM q)
SELECT pid, round(a.ref_z*(1-fx)*(1-fy) + b.ref_z*fx*(1-fy) + c.ref_z*(1-fx)*fy + d.ref_z*fx*fy, 6) AS z FROM f LEFT JOIN ref a ON a.r = r0 AND a.c = c0 LEFT JOIN ref b ON b.r = r0 AND b.c = c0+1
LEFT JOIN ref c ON c.r = r0+1 AND c.c = c0 LEFT JOIN ref d ON d.r = r0+1 AND d.c = c0+1"""


@query("pts ref", WARPED)
def r22_bilinear_warp(pts, ref):
    """Target pixels mapped back into the source, values from the four cells around."""
    at = pts.select("pid", (F.col("x") * 0.93 + 0.4).alias("x"), (F.col("y") * 0.97 + 0.3).alias("y"))
    return S.bilinear(at, ref, "ref_z").select("pid", F.round("z", 6).alias("z"))


LON, LAT = "(12.0 + x * 0.25)", "(76.0 + y * 0.08)"
UTM, POLAR = S.utm_text(LON, LAT, 15.0), S.polar_text(LON, LAT)
PROJECTED = [f"round({e}, 3) AS {n}" for e, n in zip((*UTM, *POLAR), ("utm_e", "utm_n", "polar_x", "polar_y"), strict=True)]


@query("pts", "SELECT pid, " + ", ".join(PROJECTED) + " FROM pts")
def r23_reprojection(pts):
    """Degrees to a transverse Mercator zone and to the polar stereographic plane, by closed expressions."""
    return pts.selectExpr("pid", *PROJECTED)


IDW = f""", k AS (SELECT r, c, CASE WHEN slope NOT IN (7, 8, 9) AND slope < 35 THEN ref_z END AS z FROM ref),
p AS (SELECT a.r, a.c, b.z, abs(b.r - a.r) AS dr, (a.r-b.r)*(a.r-b.r) + (a.c-b.c)*(a.c-b.c) AS d, CASE WHEN b.r <= a.r AND b.c < a.c THEN 1 WHEN b.r < a.r AND b.c >= a.c THEN 2 WHEN b.r >= a.r AND b.c > a.c THEN 3 ELSE 4 END AS q
  FROM k a JOIN k b ON a.z IS NULL AND b.z IS NOT NULL AND (a.r-b.r)*(a.r-b.r) + (a.c-b.c)*(a.c-b.c) <= {S.SEARCH * S.SEARCH}),
n AS (SELECT r, c, q, arg_min(z, (d, dr)) AS z, sqrt(min(d)::DOUBLE) AS d FROM p GROUP BY r, c, q), f AS (SELECT r, c, sum(z / d) / sum(1 / d) AS f FROM n GROUP BY r, c)
SELECT r, c, round(coalesce(z, f), 7) AS z FROM k LEFT JOIN f USING (r, c)"""


@query("ref", IDW)
def r24_inverse_distance_fill(ref):
    """Missing cells from the nearest known one of each quadrant, as far as the filling library searches."""
    k = ref.select("r", "c", F.when(~F.col("slope").isin(7, 8, 9) & (F.col("slope") < 35), F.col("ref_z")).alias("z"))
    return S.inverse_distance_fill(k, "z").select("r", "c", F.round("z", 7).alias("z"))


NINE = " ".join(f"LEFT JOIN ref z{3 * (i + 1) + j + 2} ON z{3 * (i + 1) + j + 2}.r = m.r + {i} AND z{3 * (i + 1) + j + 2}.c = m.c + {j}" for i in (-1, 0, 1) for j in (-1, 0, 1))
CURVED = f""", n AS (SELECT m.r, m.c, {', '.join(f'z{k}.ref_z + z{k}.slope*3 AS z{k}' for k in range(1, 10))} FROM ref m {NINE}),
k AS (SELECT r, c, ((z4+z6)/2-z5)/25 AS d, ((z2+z8)/2-z5)/25 AS e, (z3+z7-z1-z9)/100 AS f, (z6-z4)/10 AS g, (z2-z8)/10 AS h FROM n),
q AS (SELECT r, c, sqrt(g*g+h*h) AS slope, CASE WHEN g*g+h*h > 0 THEN 2*(d*h*h+e*g*g-f*g*h)/(g*g+h*h) WHEN g*g+h*h = 0 THEN 0 END AS planform, CASE WHEN g*g+h*h > 0 THEN -2*(d*g*g+e*h*h+f*g*h)/(g*g+h*h) WHEN g*g+h*h = 0 THEN 0 END AS profile FROM k)"""


def curved(ref):
    return S.quadric(ref.select("r", "c", (F.col("ref_z") + F.col("slope") * 3).alias("z")), "z", 5.0)


@query("ref", CURVED + " SELECT r, c, round(slope, 7) AS slope, round(planform, 7) AS planform, round(profile, 7) AS profile FROM q")
def r17_quadric_curvature(ref):
    """Slope and the two curvatures of the surface through nine cells."""
    return curved(ref).select("r", "c", *(F.round(x, 7).alias(x) for x in ("slope", "planform", "profile")))


@query("ref", CURVED + " SELECT r, c, round(greatest(abs(planform), abs(profile)), 7) AS most FROM q WHERE planform IS NOT NULL")
def r42_greatest_curvature(ref):
    """The greater of the two curvatures, where all nine cells are there."""
    return curved(ref).where("planform is not null").select("r", "c", F.round(F.greatest(F.abs("planform"), F.abs("profile")), 7).alias("most"))


FILLED = """, y AS (SELECT r, c, yr, median(CASE WHEN tag AND proba < 90 THEN z END) AS z FROM obs GROUP BY r, c, yr), g AS (SELECT r, c, yr, z FROM (SELECT r, c, yr FROM (SELECT DISTINCT r, c FROM y), range(1993, 2000) t(yr)) LEFT JOIN y USING (r, c, yr)),
l AS (SELECT r, c, yr, z, max(CASE WHEN z IS NOT NULL THEN yr END) OVER b AS y0, min(CASE WHEN z IS NOT NULL THEN yr END) OVER a AS y1, last_value(z IGNORE NULLS) OVER b AS z0, first_value(z IGNORE NULLS) OVER a AS z1 FROM g
WINDOW b AS (PARTITION BY r, c ORDER BY yr ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY r, c ORDER BY yr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
k AS (SELECT r, c, list(struct_pack(yr := yr, z := z) ORDER BY yr) FILTER (z IS NOT NULL) AS p FROM g GROUP BY r, c),
x AS (SELECT l.*, p, len(p) AS n FROM l JOIN k USING (r, c))
SELECT r, c, CAST(yr AS INT) AS yr, round(CASE WHEN z IS NOT NULL OR n IS NULL OR n < 2 THEN z WHEN y0 IS NULL THEN p[1].z + (p[2].z-p[1].z)*(yr-p[1].yr)/(p[2].yr-p[1].yr)::DOUBLE
  WHEN y1 IS NULL THEN p[n].z + (p[n].z-p[n-1].z)*(yr-p[n].yr)/(p[n].yr-p[n-1].yr)::DOUBLE ELSE z0 + (z1-z0)*(yr-y0)/(y1-y0)::DOUBLE END, 7) AS z FROM x"""


@query("obs", FILLED)
def r31_interpolate_years(obs):
    """Missing years by the line between the years around that are there, beyond the ends by the first or last two; a single
    year stays alone. A cell's years are a short array."""
    y = obs.groupBy("r", "c", "yr").agg(F.median(F.when(F.col("tag") & (F.col("proba") < 90), F.col("z"))).alias("z"))
    point = F.when(F.col("z").isNotNull() & F.col("yr").between(1993, 1999), F.struct(F.col("yr").alias("yr"), F.col("z").alias("z")))
    g = y.groupBy("r", "c").agg(F.array_sort(F.collect_list(point)).alias("p")).withColumn("yr", F.explode(F.sequence(F.lit(1993), F.lit(1999))))
    n = F.size("p")
    k = F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter("p", lambda q: q["yr"] <= F.col("yr")))))
    a, b = F.element_at("p", k), F.element_at("p", F.least(k + 1, n))
    same = F.element_at(F.filter("p", lambda q: q["yr"] == F.col("yr")), 1)
    line = F.when(n > 1, a["z"] + (b["z"] - a["z"]) * (F.col("yr") - a["yr"]) / (b["yr"] - a["yr"]).cast("double"))
    known = F.exists("p", lambda q: q["yr"] == F.col("yr"))
    return g.select("r", "c", "yr", F.round(F.when(known, same["z"]).otherwise(line), 7).alias("z"))


@query("obs", "SELECT r, c, round(CASE WHEN x THEN CAST(least(65534, round_even(sqrt(a::DOUBLE*a + b::DOUBLE*b), 0)) AS INT) ELSE b END, 0)::INT AS raw FROM (SELECT r, c, CAST(trunc(median(z)) AS INT) AS a, CAST(trunc(median(proba)) AS INT) AS b, bool_or(dem_id % 10 = 0) AS x FROM obs GROUP BY r, c)")
def r43_fit_error(obs):
    """Where a corrected fit exists its error and the other's are joined as roots of squares, elsewhere the other's stays."""
    raw = obs.groupBy("r", "c").agg(F.median("z").cast("int").alias("a"), F.median("proba").cast("int").alias("b"), F.bool_or(F.col("dem_id") % 10 == 0).alias("x"))
    return raw.select("r", "c", F.when(F.col("x"), C.hypot_raw("a", "b")).otherwise(F.col("b")).alias("raw"))


DISTANCED = """, g AS (SELECT a.r, a.c, a.slope, a.ref_z, sqrt(min((a.r-b.r)*(a.r-b.r) + (a.c-b.c)*(a.c-b.c))) AS far FROM ref a JOIN ref b ON b.slope = 50 GROUP BY ALL), o AS (SELECT CAST(floor(far) AS INT) AS bin, z/20 AS z FROM obs JOIN g USING (r, c)),
n AS (SELECT bin, 1.4826::DOUBLE*median(abs(z-m)) AS nmad, count(*) AS n FROM (SELECT *, median(z) OVER (PARTITION BY bin) AS m FROM o) GROUP BY bin), f AS (SELECT regr_slope(nmad, bin+0.5) AS b, regr_intercept(nmad, bin+0.5) AS a FROM n WHERE bin < 8)
SELECT r, c, round(CASE WHEN slope > 25 THEN a + b*least(far, 8.0::DOUBLE) ELSE 0 END, 6) AS err FROM g, f"""


@query("ref obs", DISTANCED)
def r41_gap_error_layer(ref, obs):
    """The spread by distance to a gap's edge, a line through it up to a greatest distance, and the line's value inside patches."""
    d = S.distance_transform(ref, F.col("slope") == 50)
    o = obs.select("r", "c", (F.col("z") / 20).alias("z")).join(d, ["r", "c"]).withColumn("bin", F.floor("d").cast("int"))
    n = exact_nmad(files.stored(o.select("bin", "z"), "binned"), ["bin"], "z").where("bin < 8")
    mid = F.col("bin") + 0.5
    line = n.agg(F.regr_slope("nmad", mid).alias("b"), F.regr_intercept("nmad", mid).alias("a"))  # one row
    cells = ref.select("r", "c", "slope").join(d, ["r", "c"]).join(F.broadcast(line))
    return cells.select("r", "c", F.round(F.when(F.col("slope") > 25, F.col("a") + F.col("b") * F.least("d", F.lit(8.0))).otherwise(0.0), 6).alias("err"))


#: Labels of the quality codes; years and trend intervals of the report.
QUALITY = {1: "q95", 2: "q75", 3: "bias", 4: "vertcorr"}
YEARS, INTERVALS = list(range(1993, 2000)), [(1993, 1995), (1996, 1998), (1993, 1998)]
CODED = "CAST(1 + (m >= 300)::INT + (m >= 450)::INT + (m >= 600)::INT AS INT)"
REPORT = f""", s AS (SELECT r, c, yr, median(z) AS m, count(*) AS n, 1.4826::DOUBLE * median(abs(z - mid)) AS nmad, median(dayofyear(d)) AS doy FROM (SELECT *, median(z) OVER (PARTITION BY r, c, yr) AS mid FROM obs) GROUP BY r, c, yr),
k AS (SELECT pid, p.x, p.y, s.* FROM pts p JOIN s ON s.r = CAST(floor(p.y) AS INT) AND s.c = CAST(floor(p.x) AS INT)), q AS (SELECT pid, arg_max(code, (n, -code)) AS code FROM (SELECT pid, {CODED} AS code, count(*) AS n FROM k GROUP BY ALL) GROUP BY pid)
SELECT pid, x, y, CASE code {' '.join(f"WHEN {a} THEN '{b}'" for a, b in QUALITY.items())} ELSE 'unknown(' || code || ')' END AS quality_mode,
  {', '.join(f'round(max(m) FILTER (yr = {y}), 9) AS dem_{y}, round(max(nmad) FILTER (yr = {y}), 9) AS nmad_{y}, max(n) FILTER (yr = {y}) AS count_{y}, max(doy) FILTER (yr = {y}) AS doy_{y}' for y in YEARS)},
  {', '.join(f'round(regr_slope(m, yr + (doy - 1) / 365.25) FILTER (yr BETWEEN {a} AND {b}), 6) AS slope_{a}_{b}, round(regr_intercept(m, yr - {a} + (doy - 1) / 365.25) FILTER (yr BETWEEN {a} AND {b}), 5) AS intercept_{a}_{b}' for a, b in INTERVALS)}
FROM k JOIN q USING (pid) GROUP BY pid, x, y, code"""


@query("pts obs", REPORT)
def r44_point_report(pts, obs):
    """Every point's series as columns in a fixed order: value, spread, count and day of each year, trends of each interval over the
    years with their day, and the label of the commonest quality code (an unknown code is shown as such)."""
    day = F.median(F.dayofyear("d")).alias("doy")
    s = G.robust_stack(obs.select("r", "c", "yr", "z", "d"), ["r", "c", "yr"], "z", day).withColumnRenamed("median", "m")
    at = pts.select("pid", "x", "y", F.floor("y").cast("int").alias("r"), F.floor("x").cast("int").alias("c"))
    k = files.stored(at.join(s, ["r", "c"]).withColumn("code", C.digitise("m", [300, 450, 600]) + 1), "series")
    mode = k.groupBy("pid", "code").agg(F.count("*").alias("n")).groupBy("pid").agg(F.max_by("code", F.struct("n", -F.col("code"))).alias("code"))
    label = F.concat(F.lit("unknown("), F.col("code").cast("string"), F.lit(")"))
    for code, name in QUALITY.items():
        label = F.when(F.col("code") == code, name).otherwise(label)
    of = lambda y, c, digits: F.round(F.max(F.when(F.col("yr") == y, F.col(c))), digits)
    wide = [x for y in YEARS for x in (of(y, "m", 9).alias(f"dem_{y}"), of(y, "nmad", 9).alias(f"nmad_{y}"), F.max(F.when(F.col("yr") == y, F.col("n"))).alias(f"count_{y}"), F.max(F.when(F.col("yr") == y, F.col("doy"))).alias(f"doy_{y}"))]
    when = (F.col("doy") - 1) / 365.25
    for a, b in INTERVALS:
        inside = F.when(F.col("yr").between(a, b), F.col("m"))
        wide += [F.round(F.regr_slope(inside, F.col("yr") + when), 6).alias(f"slope_{a}_{b}"), F.round(F.regr_intercept(inside, F.col("yr") - a + when), 5).alias(f"intercept_{a}_{b}")]
    rows = k.groupBy("pid", "x", "y").agg(*wide).join(mode, "pid")
    return rows.select("pid", "x", "y", label.alias("quality_mode"), *(c for c in rows.columns if c not in ("pid", "x", "y", "code")))


#: The share of the median count below which a bin is left out; two years need more.
LEAST_SHARE, LEAST_BY_YEAR = 0.1, {2022: 0.27, 2023: 0.2}
BIAS = f""", o AS (SELECT r, c, yr, median(z) / 3 AS z, 1.4826::DOUBLE * median(abs(z - m)) AS nmad FROM (SELECT *, median(z) OVER (PARTITION BY r, c, yr) AS m FROM obs) GROUP BY r, c, yr),
d AS (SELECT yr, c + 0.5::DOUBLE AS x, r + 0.5::DOUBLE AS y, ref_z - z AS v FROM o JOIN ref USING (r, c) WHERE stable AND nmad < 200),
b AS (SELECT yr, floor(x / 8) AS bx, floor(y / 8) AS by_, median(x) AS x, median(y) AS y, median(v) AS v, count(*) AS n FROM d GROUP BY ALL)
SELECT yr, x, y, round(v, 7) AS v, round(share, 9) AS share FROM (SELECT *, n / median(n) OVER (PARTITION BY yr) AS share FROM b) WHERE share > CASE {' '.join(f'WHEN yr = {k} THEN {v}' for k, v in LEAST_BY_YEAR.items())} ELSE {LEAST_SHARE} END"""


def bias_bins(obs, ref):
    """Medians of differences on stable ground by year and coarse bin, without thin bins."""
    o = G.robust_stack(obs.select("r", "c", "yr", "z"), ["r", "c", "yr"], "z").where("nmad < 200").select("r", "c", "yr", (F.col("median") / 3).alias("z"))
    d = o.join(ref.where("stable").select("r", "c", "ref_z"), ["r", "c"]).select("yr", (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"), (F.col("ref_z") - F.col("z")).alias("v"))
    b = d.groupBy("yr", F.floor(F.col("x") / 8).alias("bx"), F.floor(F.col("y") / 8).alias("by")).agg(*(F.median(c).alias(c) for c in "xyv"), F.count("*").alias("n"))
    b = files.stored(b, "bins")
    usual = b.groupBy("yr").agg(F.percentile("n", 0.5).alias("usual"))  # a count per bin: its percentile counts equal ones together
    least = F.lit(LEAST_SHARE)
    for yr, share in LEAST_BY_YEAR.items():
        least = F.when(F.col("yr") == yr, share).otherwise(least)
    return b.join(G.checked_broadcast(usual), "yr").withColumn("share", F.col("n") / F.col("usual")).where(F.col("share") > least)


@query("obs ref", BIAS)
def r06_bias_bins(obs, ref):
    """The points of the bias surface of every year."""
    return bias_bins(obs, ref).select("yr", "x", "y", F.round("v", 7).alias("v"), F.round("share", 9).alias("share"))


@query("obs ref", None)
def r06_bias_surface(obs, ref):
    """The last year's bias at every cell: a linear radial surface through its bins."""
    bins = files.stored(bias_bins(obs, ref), "bias")
    last = bins.join(F.broadcast(bins.agg(F.max("yr").alias("yr"))), "yr")  # one row
    at = ref.select("r", "c", (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"))
    return radial_surface(last.select("x", "y", "v"), at).select("r", "c", F.round("z", 6).alias("z"))


def add_recursive(name: str, sql: str) -> None:
    """SQL that starts with its own WITH RECURSIVE."""
    from gridloom.plans.registry import ORACLE

    ORACLE[name] = sql


add_recursive("a29_components", components_sql(" SELECT r, c, label AS least, count(*) OVER (PARTITION BY label) AS size FROM m JOIN l USING (i)"))
KEPT = """WITH RECURSIVE {views}, o AS (SELECT DISTINCT a.r, a.c FROM ref a JOIN ref b ON abs(a.r-b.r) + abs(a.c-b.c) <= 3 WHERE b.slope <= 2), m AS (SELECT r, c, r*1000 + c AS i FROM ref ANTI JOIN o USING (r, c)),
t(i, r, c, j) AS (SELECT i, r, c, i FROM m UNION SELECT t.i, m.r, m.c, m.i FROM t JOIN m ON abs(m.r-t.r) + abs(m.c-t.c) = 1), l AS (SELECT i, min(j) AS label FROM t GROUP BY i),
s AS (SELECT r, c, count(*) OVER (PARTITION BY label) AS size FROM m JOIN l USING (i)) SELECT ref.r, ref.c, NOT coalesce(size >= 0.01 * (SELECT max(size) FROM s), false) AS outlier FROM ref LEFT JOIN s USING (r, c)"""
add_recursive("r13_conditioned_mask", KEPT.format(views=__import__("gridloom.sources.adapters", fromlist=["SQL"]).SQL["ref"]))
