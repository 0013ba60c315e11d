"""Sampling, range, nearest and as-of joins, windows, sorts and set operations."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.functions import columns as C
from gridloom.operators import grid as G
from gridloom.plans.registry import query
from gridloom.sources.adapters import TILE


def sample(pts, cells, cols):
    """The cell under each point; null outside the grid."""
    at = pts.withColumn("c", F.floor("x").cast("int")).withColumn("r", F.floor("y").cast("int"))
    return at.join(cells.select("r", "c", *cols), ["r", "c"], "left")


@query("pts ref", "SELECT pid, v, ref_z, slope FROM pts LEFT JOIN ref ON r = CAST(floor(y) AS INT) AND c = CAST(floor(x) AS INT)")
def j02_sample_points(pts, ref):
    return sample(pts, ref, ["ref_z", "slope"]).select("pid", "v", "ref_z", "slope")


@query("pts ref obs", "SELECT pid, v, ref_z, z FROM pts JOIN ref ON r = CAST(floor(y) AS INT) AND c = CAST(floor(x) AS INT) JOIN (SELECT r, c, round(median(z), 9) AS z FROM obs WHERE yr = 1997 GROUP BY r, c) o USING (r, c) WHERE slope > 10")
def j03_multi_sample(pts, ref, obs):
    """Sampled in sequence, with points dropped in between."""
    first = sample(pts, ref, ["ref_z", "slope"]).where("slope > 10").drop("slope")
    z = obs.where("yr = 1997").groupBy("r", "c").agg(F.round(F.median("z"), 9).alias("z"))
    return first.join(z, ["r", "c"]).select("pid", "v", "ref_z", "z")


TILED = "(tx0 {0} x1 AND tx1 {1} x0 AND ty0 {0} y1 AND ty1 {1} y0)"


@query("strips tiles", "SELECT strip, tr, tc FROM strips, tiles WHERE " + TILED.format("<=", ">="))
def j05_strip_tile_range_join(strips, tiles):
    return G.range_join_by_tile(strips, tiles, float(TILE), C.overlap_closed("", "t")).select("strip", "tr", "tc")


@query("strips tiles", "SELECT tr, tc, count(*) AS n, CAST(min(d) AS VARCHAR) AS first FROM strips, tiles WHERE status = 'F' AND " + TILED.format("<", ">") + " GROUP BY tr, tc")
def j05_tiles_with_strips(strips, tiles):
    found = G.range_join_by_tile(strips.where("status = 'F'"), tiles, float(TILE), C.overlap_open("", "t"))
    return found.groupBy("tr", "tc").agg(F.count("*").alias("n"), F.min("d").cast("string").alias("first"))


BOX = "b AS (SELECT zone, min(c)+0.0 AS x0, min(r)+0.0 AS y0, max(c)+1.0 AS x1, max(r)+1.0 AS y1 FROM ref WHERE slope = 7 GROUP BY zone)"
COVERED = "d AS (SELECT zone, min(tx0) AS x0, min(ty0) AS y0, max(tx1) AS x1, max(ty1) AS y1 FROM b, tiles WHERE " + TILED.format("<=", ">=") + " GROUP BY zone)"
TOUCH = "SELECT zone, min(tx0) AS x0, min(ty0) AS y0, max(tx1) AS x1, max(ty1) AS y1, count(*) AS n FROM d, tiles WHERE {0} AND NOT {1} GROUP BY zone"


@query("ref tiles", TOUCH.format(TILED.format("<=", ">="), TILED.format("<", ">")), BOX, COVERED)
def j06_region_tile_bounds(ref, tiles):
    """The bounds of the tiles that touch, without overlap, the box of all tiles that a region's box meets."""
    far = (F.max("c") + 1.0).alias("x1"), (F.max("r") + 1.0).alias("y1")
    box = ref.where("slope = 7").groupBy("zone").agg(F.min("c").cast("double").alias("x0"), F.min("r").cast("double").alias("y0"), *far)
    bounds = [F.min("tx0").alias("x0"), F.min("ty0").alias("y0"), F.max("tx1").alias("x1"), F.max("ty1").alias("y1")]
    whole = G.range_join_by_tile(box, tiles, float(TILE), C.overlap_closed("", "t")).groupBy("zone").agg(*bounds)
    touching = C.overlap_closed("", "t") & ~C.overlap_open("", "t")
    return G.range_join_by_tile(whole, tiles, float(TILE), touching).groupBy("zone").agg(*bounds, F.count("*").alias("n"))


@query("ref", "SELECT a.r, a.c, CAST(min((b.r-a.r)*(b.r-a.r)+(b.c-a.c)*(b.c-a.c)) AS INT) AS d2, round(arg_min(b.ref_z, ((b.r-a.r)*(b.r-a.r)+(b.c-a.c)*(b.c-a.c))*100 + (b.r-a.r)*10 + (b.c-a.c)), 9) AS z FROM ref a JOIN ref b ON abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 WHERE a.slope > 30 AND b.slope <= 30 GROUP BY a.r, a.c")
def j10_edge_nearest(ref):
    """The nearest stable cell next to an unstable one, by shifted equi-joins; ties by place."""
    near = G.neighbours(ref.where("slope <= 30").select("r", "c", "ref_z"), [o for o in G.SQUARE if o != (0, 0)])
    d2 = F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")
    both = ref.where("slope > 30").select("r", "c").join(near, ["r", "c"])
    return both.groupBy("r", "c").agg(F.min(d2).cast("int").alias("d2"), F.round(F.min_by("ref_z", d2 * 100 + F.col("dr") * 10 + F.col("dc")), 9).alias("z"))


ASOF_ALL = """SELECT l.event_id, CASE WHEN n.ts IS NOT NULL AND (p.ts IS NULL OR epoch_us(n.ts) - epoch_us(l.ts) < epoch_us(l.ts) - epoch_us(p.ts)) THEN n.v ELSE p.v END AS near_value
FROM series l ASOF LEFT JOIN (SELECT user_id, ts, max(h) AS v FROM series WHERE track = 'signup' GROUP BY ALL) p ON l.user_id = p.user_id AND l.ts >= p.ts
ASOF LEFT JOIN (SELECT user_id, ts, min(h) AS v FROM series WHERE track = 'signup' GROUP BY ALL) n ON l.user_id = n.user_id AND l.ts < n.ts"""


@query("series", ASOF_ALL)
def j12_asof_all(series):
    """J12 over whole tables: for every event the value of its user's signup event nearest in time, the earlier of two as near."""
    got = G.asof_nearest(series.select("event_id", "user_id", "ts"), series.where("track = 'signup'"), ["user_id"], "ts", "h")
    return got.select("event_id", "near_value")


@query("series", ", s AS (SELECT track, ts, lag(ts) OVER (PARTITION BY track ORDER BY ts) AS lo FROM (SELECT DISTINCT track, date_trunc('day', ts) AS ts FROM series)) SELECT event_id, CAST(date_diff('day', lo, s.ts) AS INT) AS days FROM series JOIN s ON s.track = series.track AND series.ts > lo AND series.ts <= s.ts")
def j13_bracketing_pairs(series):
    """The pair of survey days around each event; the interval join is an equi-join on the day (gaps are days)."""
    day = series.select("track", F.date_trunc("day", "ts").alias("hi")).distinct()
    w = W.partitionBy("track").orderBy("hi")
    spans = day.withColumn("lo", F.lag("hi").over(w)).where("lo is not null")
    listed = spans.withColumn("day", F.explode(F.sequence(F.col("lo"), F.col("hi"), F.expr("interval 1 day"))))
    ev = series.select("event_id", "track", "ts", F.date_trunc("day", "ts").alias("day"))
    return ev.join(listed, ["track", "day"]).where("ts > lo and ts <= hi").select("event_id", F.datediff("hi", "lo").alias("days"))


LERP = """, k AS (SELECT CAST(floor(slope/10.0) AS INT)*10.0::DOUBLE AS x, avg(ref_z) AS y FROM ref GROUP BY 1), s AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1, lag(x) OVER (ORDER BY x) IS NULL AS f, lead(x, 2) OVER (ORDER BY x) IS NULL AS l FROM k)
SELECT r, c, round(y0 + (slope+a-x0)/(x1-x0)*(y1-y0), 7) AS y FROM (SELECT *, 2.5 AS a FROM ref) JOIN s ON x1 IS NOT NULL AND (f OR slope+a >= x0) AND (l OR slope+a < x1)"""


@query("ref", LERP)
def j14_lerp_lookup(ref):
    """Linear interpolation in a curve, with its end segments extended."""
    curve = ref.groupBy((C.uniform_bin("slope", 0, 10.0) * 10.0).alias("kx")).agg(F.avg("ref_z").alias("ky"))
    at = ref.select("r", "c", (F.col("slope") + 2.5).alias("x"))
    return G.lerp_lookup(at, curve, "x", "kx", "ky", "y").select("r", "c", F.round("y", 7).alias("y"))


@query("ref obs", "SELECT coalesce(ref.r, o.r) AS r, coalesce(ref.c, o.c) AS c, ref_z, z FROM (SELECT * FROM ref WHERE stable) ref FULL JOIN (SELECT r, c, round(median(z),9) AS z FROM obs WHERE yr = 1999 GROUP BY r, c) o ON ref.r = o.r AND ref.c = o.c")
def j17_merge_by_coords(ref, obs):
    z = obs.where("yr = 1999").groupBy("r", "c").agg(F.round(F.median("z"), 9).alias("z"))
    return ref.where("stable").select("r", "c", "ref_z").join(z, ["r", "c"], "full").select("r", "c", "ref_z", "z")


@query("ref", "SELECT r, c FROM ref WHERE ref_z > 930 AND NOT (stable OR zone IN ('Brand#11', 'Brand#22') OR slope < 5)")
def j20_mask_algebra(ref):
    """Land and not (glacier or water or moraine) as one boolean expression."""
    out = F.col("stable") | F.col("zone").isin("Brand#11", "Brand#22") | (F.col("slope") < 5)
    return ref.where((F.col("ref_z") > 930) & ~out).select("r", "c")


@query("series", "SELECT event_id, round(h - lag(h) OVER (PARTITION BY track ORDER BY ts, event_id), 9) AS dh FROM series")
def w01_lag_pairs(series):
    """Differences along a track; its days are ordered apart, as there are few tracks."""
    pairs = G.lag_by_parts(series.select("event_id", "track", "ts", "h"), ["track"], F.to_date("ts"), ["ts", "event_id"], "h", "before")
    return pairs.select("event_id", F.round(F.col("h") - F.col("before"), 9).alias("dh"))


YEARLY = "y AS (SELECT r, c, yr, median(z) AS z FROM obs GROUP BY r, c, yr)"


def yearly(obs):
    return obs.groupBy("r", "c", "yr").agg(F.median("z").alias("z"))


def cell():
    return W.partitionBy("r", "c").orderBy("yr")


@query("obs", "SELECT r, c, yr, round((d - lag(d) OVER w)/2, 8) AS dd FROM (SELECT *, z - lag(z) OVER (PARTITION BY r, c ORDER BY yr) AS d FROM y) WINDOW w AS (PARTITION BY r, c ORDER BY yr)", YEARLY)
def w02_second_difference(obs):
    d = yearly(obs).withColumn("d", F.col("z") - F.lag("z").over(cell()))
    return d.select("r", "c", "yr", F.round((F.col("d") - F.lag("d").over(cell())) / 2, 8).alias("dd"))


@query("obs", "SELECT r, c, yr, round(avg(z) OVER (PARTITION BY r, c ORDER BY yr ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 8) AS m FROM y", YEARLY)
def w03_rolling_mean(obs):
    return yearly(obs).select("r", "c", "yr", F.round(F.avg("z").over(cell().rowsBetween(-1, 1)), 8).alias("m"))


@query("obs", "SELECT r, c, yr, round(median(z) OVER (PARTITION BY r, c ORDER BY yr RANGE BETWEEN 1 PRECEDING AND 2 FOLLOWING), 8) AS m FROM y", YEARLY)
def w04_rolling_year_median(obs):
    """A window of years -1..+2, both ends included."""
    return yearly(obs).select("r", "c", "yr", F.round(F.percentile("z", F.lit(0.5)).over(cell().rangeBetween(-1, 2)), 8).alias("m"))


GRIDDED = "g AS (SELECT r, c, yr, max(CASE WHEN tag AND proba < 60 THEN z END) AS z FROM obs GROUP BY r, c, yr)"


@query("obs", "SELECT r, c, yr, coalesce(last_value(z IGNORE NULLS) OVER (PARTITION BY r, c ORDER BY yr), first_value(z IGNORE NULLS) OVER (PARTITION BY r, c ORDER BY yr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS z FROM g", GRIDDED)
def w07_fill(obs):
    g = obs.groupBy("r", "c", "yr").agg(F.max(F.when(F.col("tag") & (F.col("proba") < 60), F.col("z"))).alias("z"))
    back = F.first("z", ignorenulls=True).over(cell().rowsBetween(0, W.unboundedFollowing))
    return g.select("r", "c", "yr", F.coalesce(F.last("z", ignorenulls=True).over(cell()), back).alias("z"))


#: Ids of one range, whose rows are ordered together.
ID_RANGE = 65_536


@query("series", "SELECT event_id, epoch_us(ts) // 3600000000 * 3600 + (row_number() OVER (PARTITION BY track, epoch_us(ts) // 3600000000 ORDER BY event_id) - 1) AS t FROM series")
def w10_time_dedup(series):
    """A second more for each further row of the same hour. An hour's rows are counted by ranges of ids and ordered within a range
    only, so an hour with very many rows isn't one task's."""
    hour = F.floor(F.unix_micros("ts") / F.lit(3_600_000_000)).cast("long").alias("hour")
    x = series.select("event_id", "track", hour, F.floor(F.col("event_id") / F.lit(ID_RANGE)).alias("part"))
    counts = x.groupBy("track", "hour", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("track", "hour").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    ahead = counts.select("track", "hour", "part", F.coalesce(before, F.lit(0)).alias("ahead"))
    within = F.row_number().over(W.partitionBy("track", "hour", "part").orderBy("event_id")) - 1
    return x.withColumn("within", within).join(ahead, ["track", "hour", "part"]).select("event_id", (F.col("hour") * 3600 + F.col("ahead") + F.col("within")).alias("t"))


@query("tiles", "SELECT tr, tc FROM tiles ORDER BY (tx0+4-20)*(tx0+4-20)+(ty0+4-25)*(ty0+4-25), tr, tc LIMIT 10")
def t04_nearest_tiles_topk(tiles):
    dx, dy = F.col("tx0") + 4 - 20, F.col("ty0") + 4 - 25
    return tiles.orderBy(dx * dx + dy * dy, "tr", "tc").limit(10).select("tr", "tc")


@query("pts", "SELECT pid, prio FROM (SELECT pid, 0 AS prio FROM pts WHERE seg = 'BUILDING' AND v > 8000 UNION ALL SELECT pid, 1 AS prio FROM pts WHERE v < 0) ORDER BY prio, (pid*7919) % 10007, pid LIMIT 60")
def t05_priority_limit(pts):
    a = pts.where("seg = 'BUILDING' and v > 8000").select("pid", F.lit(0).alias("prio"))
    return a.unionByName(pts.where("v < 0").select("pid", F.lit(1).alias("prio"))).orderBy("prio", (F.col("pid") * 7919) % 10007, "pid").limit(60)


@query("pts", "SELECT pid, bin FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY (pid*7919) % 10007, pid) AS k, CAST(bin + 2 AS BIGINT) AS want FROM (SELECT pid, CAST(floor(x/8.0) AS INT) AS bin FROM pts)) WHERE k <= want")
def t09_stratified_match(pts):
    """Of each bin the first few by a hash; every task leaves its own first few before a bin's are put together."""
    b = pts.select("pid", C.uniform_bin("x", 0, 8.0).alias("bin"), ((F.col("pid") * 7919) % 10007).alias("h"))
    first = lambda df, *by: df.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy("h", "pid"))).where(F.col("k") <= F.col("bin") + 2)
    return first(first(b.withColumn("s", F.pmod(F.xxhash64("pid"), F.lit(256))), "bin", "s"), "bin").select("pid", "bin")


@query("obs dems", "SELECT dem_id FROM obs WHERE z > 800 UNION SELECT dem_id FROM dems WHERE n_cmp < 30")
def s01_exclusion_union(obs, dems):
    return obs.where("z > 800").select("dem_id").union(dems.where("n_cmp < 30").select("dem_id")).distinct()


@query("obs", "SELECT r, c FROM obs WHERE yr = 1996 INTERSECT SELECT r, c FROM obs WHERE yr = 1997 INTERSECT SELECT r, c FROM obs WHERE yr = 1998")
def s03_tile_intersection(obs):
    """S3: cells that have all of the years; one aggregation instead of a chain of intersections."""
    years = [1996, 1997, 1998]
    return obs.where(F.col("yr").isin(years)).groupBy("r", "c").agg(F.countDistinct("yr").alias("n")).where(F.col("n") == len(years)).select("r", "c")


@query("obs", "SELECT r, c, z FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY d, ok, ln) AS k FROM obs) WHERE k = 1")
def s04_first_by_key(obs):
    """The first row by key as an aggregate, so that a map-side step leaves one row per cell."""
    return obs.groupBy("r", "c").agg(F.min_by("z", F.struct("d", "ok", "ln")).alias("z"))


@query("ref", "SELECT r, c FROM ref WHERE slope IN (3, 5) EXCEPT SELECT r, c FROM ref WHERE ref_z < 930")
def s05_except(ref):
    return ref.where("slope in (3, 5)").select("r", "c").join(ref.where("ref_z < 930").select("r", "c"), ["r", "c"], "left_anti").distinct()


@query("ref", "SELECT r, c FROM ref WHERE stable <> (ref_z > 945)")
def s06_mask_xor(ref):
    return ref.where(F.col("stable") != (F.col("ref_z") > 945)).select("r", "c")


@query("ref", "SELECT a.r, a.c, coalesce(b.slope * 10, a.slope) AS v FROM ref a LEFT JOIN (SELECT * FROM ref WHERE zone = 'Brand#11') b USING (r, c)")
def s08_replacement_list(ref):
    """The corrected value where there is one, else the plain one."""
    fixed = ref.where("zone = 'Brand#11'").select("r", "c", (F.col("slope") * 10).alias("f"))
    return ref.select("r", "c", "slope").join(fixed, ["r", "c"], "left").select("r", "c", F.coalesce("f", "slope").alias("v"))


@query("series", "SELECT event_id, len(json_keys(props)) AS n_keys, length(props) AS n FROM series")
def d12_json_extract(series):
    return series.select("event_id", F.size(F.json_object_keys("props")).alias("n_keys"), F.length("props").alias("n"))
