"""Scalar functions, codecs, filters, lookups, samples and further aggregates."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.functions import columns as C
from gridloom.functions import gridmath as M
from gridloom.operators import grid as G
from gridloom.operators.quantiles import exact_nmad
from gridloom.plans.registry import query
from gridloom.sources.adapters import TILE
from gridloom.sources.files import stored

ALIGN = "floor((x0-2.5)/5)*5 + 2.5 - 10 AS l, ceil((y0-1.5)/3)*3 + 1.5 - 10 AS b, floor((x1-2.5)/5)*5 + 2.5 + 10 AS r, ceil((y1-1.5)/3)*3 + 1.5 + 10 AS t"


@query("strips", f"SELECT strip, {ALIGN} FROM strips")
def u_align_bounds(strips):
    """Bounds aligned to half a step, with a buffer."""
    got = M.align("x0", "y0", "x1", "y1", (5.0, 3.0), half=True, buffer=10.0)
    return strips.select("strip", *(c.alias(n) for c, n in zip(got, "lbrt", strict=True)))


@query("strips", "SELECT strip, CAST(trunc((y1-y0)/0.3::DOUBLE) AS INT) AS rows, CAST(trunc((x1-x0)/0.7::DOUBLE) AS INT) AS cols, round((x1-x0)/4, 9) AS rx, round((y1-y0)/3, 9) AS ry FROM strips")
def u_shape_and_resolution(strips):
    rows, cols = M.shape("x0", "y0", "x1", "y1", (0.7, 0.3))
    rx, ry = M.resolution("x0", "y0", "x1", "y1", F.lit(3), F.lit(4))
    return strips.select("strip", rows.alias("rows"), cols.alias("cols"), F.round(rx, 9).alias("rx"), F.round(ry, 9).alias("ry"))


@query("strips", "SELECT strip, CAST(floor((x0-1.5+10)/0.5) AS INT) AS col, CAST(floor((80-(y1+1.5))/0.5) AS INT) AS row, CAST((x1-x0+3)*2 AS INT) AS width, CAST((y1-y0+3)*2 AS INT) AS height FROM strips")
def u_padded_window(strips):
    """The pixels of bounds with a margin."""
    l, b, r, t = M.pad("x0", "y0", "x1", "y1", 1.5)
    got = M.window(l, b, r, t, -10.0, 80.0, 0.5)
    return strips.select("strip", *(c.alias(n) for c, n in zip(got, ("col", "row", "width", "height"), strict=True)))


CHUNKS = """, s AS (SELECT *, CAST(trunc((y1-y0)/0.5) AS INT) AS rows, CAST(trunc((x1-x0)/0.5) AS INT) AS cols FROM strips), n AS (SELECT *, CAST(ceil(rows/4.0) AS INT) AS down, CAST(ceil(cols/4.0) AS INT) AS across FROM s),
e AS (SELECT *, unnest(range(0, down*across)) AS i FROM n), p AS (SELECT *, i % across AS col, i // across AS row, CAST(ceil(log10(greatest(down, across))) + 1 AS INT) AS digits FROM e)
SELECT strip, CAST(i AS INT) AS i, x0 + col*2.0 AS l, y1 - least((row+1)*4, rows)*0.5 AS b, x0 + least((col+1)*4, cols)*0.5 AS r, y1 - row*2.0 AS t,
'chunk_' || lpad(CAST(row AS VARCHAR), digits, '0') || '_' || lpad(CAST(col AS VARCHAR), digits, '0') AS name FROM p"""


@query("strips", CHUNKS)
def u_chunks(strips):
    """Chunks row by row from the upper left, the last of a row or column cut, with their names."""
    c = M.with_chunks(strips, 0.5, 4)
    name = M.chunk_name("row", "col", "down", "across")
    return c.select("strip", "i", F.col("left").alias("l"), F.col("bottom").alias("b"), F.col("right").alias("r"), F.col("top").alias("t"), name.alias("name"))


@query("dems", "SELECT dem_id, sha256(region || CAST(dem_id AS VARCHAR) || 'v1') AS sum FROM dems")
def u_checksum(dems):
    return dems.select("dem_id", M.checksum("region", "dem_id", F.lit("v1")).alias("sum"))


@query("ref", "SELECT r, c, round(degrees(atan(slope/30.0::DOUBLE)), 9) AS deg, round(cos(radians(slope*7.0::DOUBLE))*c, 9) AS x, round(sin(radians(slope*7.0::DOUBLE))*c, 9) AS y FROM ref")
def u_angles(ref):
    """Slope in degrees, a point on a ring."""
    turn = F.radians(F.col("slope") * 7.0)
    return ref.select("r", "c", F.round(F.degrees(F.atan(F.col("slope") / 30.0)), 9).alias("deg"), F.round(F.cos(turn) * F.col("c"), 9).alias("x"), F.round(F.sin(turn) * F.col("c"), 9).alias("y"))


POLY = "SELECT dem_id, round(pa*27*s*s*s + pb*9*s*s + 2*pc*s + 1, 7) AS at, round(p0, 7) AS p0, round(p1, 7) AS p1, round(p2, 7) AS p2, round(p3, 7) AS p3 FROM (SELECT *, 0.5::DOUBLE AS s, 1 + 2*pc*2.0 + 9*pb*4.0 + 27*pa*8.0 AS p0, 2*pc + 2*9*pb*2.0 + 3*27*pa*4.0 AS p1, 9*pb + 3*27*pa*2.0 AS p2, 27*pa AS p3 FROM dems)"


@query("dems", POLY)
def u_polynomial(dems):
    """A polynomial's value by Horner's rule and its coefficients about another point."""
    low = [F.lit(1.0), 2 * F.col("pc"), 9 * F.col("pb"), 27 * F.col("pa")]
    got = dems.select("dem_id", C.polynomial(F.array(*low[::-1]), F.lit(0.5)).alias("at"), M.taylor_shift(F.array(*low), F.lit(2.0)).alias("p"))
    return got.select("dem_id", F.round("at", 7).alias("at"), *(F.round(F.col("p")[i], 7).alias(f"p{i}") for i in range(4)))


@query("dems", "SELECT dem_id, round(3*27*pa*s*s + 2*9*pb*s + 2*pc, 7) AS slope, round(6*27*pa*s + 2*9*pb, 7) AS bend FROM (SELECT *, 0.5::DOUBLE AS s FROM dems)")
def u_derivatives(dems):
    """First and second derivative of a polynomial at a point."""
    once = C.derivative(F.array(27 * F.col("pa"), 9 * F.col("pb"), 2 * F.col("pc"), F.lit(1.0)))
    got = dems.select("dem_id", once.alias("d1")).withColumn("d2", C.derivative(F.col("d1")))
    return got.select("dem_id", F.round(C.polynomial("d1", F.lit(0.5)), 7).alias("slope"), F.round(C.polynomial("d2", F.lit(0.5)), 7).alias("bend"))


@query("ref", "SELECT r, c, round(w*4.0::DOUBLE*exp(-(x-10)*(x-10)/18.0) + (1-w)*(0.05::DOUBLE*x+0.5::DOUBLE), 9) AS y FROM (SELECT r, c, slope::DOUBLE AS x, 1/(1+exp(0.8::DOUBLE*(slope-20))) AS w FROM ref)")
def u_model_curve(ref):
    return ref.select("r", "c", F.round(M.peak_with_tail("slope", 4.0, 10.0, 3.0, 0.05, 0.5, 0.8, 20.0), 9).alias("y"))


@query("ref", "SELECT zone || n AS name, replace(replace(zone || n, '_slope', '_se'), '_accel', '_accel_se') AS err, count(*) AS n FROM ref, (VALUES ('_slope'), ('_accel'), ('_dem')) v(n) GROUP BY ALL")
def u_name_maps(ref):
    each = ref.select("zone", F.explode(F.array(F.lit("_slope"), F.lit("_accel"), F.lit("_dem"))).alias("n"))
    return each.withColumn("name", F.concat("zone", "n")).groupBy("name", M.error_name("name").alias("err")).agg(F.count("*").alias("n"))


# --- codecs --------------------------------------------------------------------------------------------

UNSIGNED = "CAST(trunc(greatest(0, least(65534, CAST(CAST({v} AS FLOAT)*CAST(65534/{m}::DOUBLE AS FLOAT) AS DOUBLE)))) AS INT)"


@query("dems", f"SELECT dem_id, nmad, se, round(nmad*100/65534::DOUBLE, 9) AS nmad_back, round(se*10/65534::DOUBLE, 9) AS se_back FROM (SELECT dem_id, {UNSIGNED.format(v='pc*20', m=100)} AS nmad, {UNSIGNED.format(v='pc', m=10)} AS se FROM dems)")
def q02_nmad_and_error_codec(dems):
    raw = dems.select("dem_id", C.encode_unsigned(F.col("pc") * 20, C.NMAD_MAX).alias("nmad"), C.encode_unsigned("pc", C.SE_MAX).alias("se"))
    return raw.select("*", F.round(C.decode_unsigned("nmad", C.NMAD_MAX), 9).alias("nmad_back"), F.round(C.decode_unsigned("se", C.SE_MAX), 9).alias("se_back"))


@query("ref", "SELECT r, c, coalesce(CASE WHEN slope < 40 THEN slope END, 0) AS small, CASE WHEN zone IN ('Brand#11', 'Brand#12') THEN CAST(stable AS INT) ELSE 255 END AS flag, coalesce(CASE WHEN stable THEN CAST(ref_z AS FLOAT) END, -9999) AS z FROM ref")
def q05_other_codecs(ref):
    """Small whole numbers with nodata 0, flags with nodata 255, single precision with nodata -9999."""
    flag = F.when(F.col("zone").isin("Brand#11", "Brand#12"), F.col("stable").cast("int"))
    z = F.when(F.col("stable"), F.col("ref_z").cast("float"))
    return ref.select("r", "c", F.coalesce(F.when(F.col("slope") < 40, F.col("slope")), F.lit(0)).alias("small"), F.coalesce(flag, F.lit(255)).alias("flag"), F.coalesce(z, F.lit(-9999.0).cast("float")).alias("z"))


SLOPE_SCALE = 0.001373311970702678


@query("ref", f"SELECT r, c, CAST(round_even(deg/{SLOPE_SCALE}::DOUBLE, 0) AS INT) AS raw, round(CAST(round_even(deg/{SLOPE_SCALE}::DOUBLE, 0) AS INT)*{SLOPE_SCALE}::DOUBLE, 9) AS back FROM (SELECT r, c, degrees(atan(slope/30.0::DOUBLE)) AS deg FROM ref)")
def q06_slope_map_codec(ref):
    """Degrees from 0 to 90 over 16 bits."""
    raw = F.rint(F.degrees(F.atan(F.col("slope") / 30.0)) / SLOPE_SCALE).cast("int")
    return ref.select("r", "c", raw.alias("raw")).withColumn("back", F.round(F.col("raw") * SLOPE_SCALE, 9))


@query("obs", "SELECT ok, ln, raw, CASE WHEN raw <> 255 THEN round(raw/255.0::DOUBLE, 9) END AS p FROM (SELECT ok, ln, CASE WHEN tag THEN CAST(trunc(proba/255*255) AS INT) ELSE 255 END AS raw FROM obs)")
def q07_probability_byte(obs):
    """Probabilities truncated to a byte; 255 doubles as nodata."""
    raw = F.when(F.col("tag"), (F.col("proba") / 255 * 255).cast("int")).otherwise(255)
    return obs.select("ok", "ln", raw.alias("raw")).withColumn("p", F.when(F.col("raw") != 255, F.round(F.col("raw") / F.lit(255.0), 9)))


@query("dems", "SELECT dem_id, CASE WHEN a <> -32768 AND b <> -32768 THEN a + b ELSE -32768 END AS raw FROM (SELECT dem_id, CASE WHEN n_cmp % 5 = 0 THEN -32768 ELSE CAST(trunc(greatest(-32767.0::DOUBLE, least(32766.0::DOUBLE, pc*32766/50))) AS INT) END AS a, CAST(trunc(greatest(-32767.0::DOUBLE, least(32766.0::DOUBLE, pb*1000*32766/50))) AS INT) AS b FROM dems)")
def q09_raw_sum(dems):
    """Two signed rasters of one scale added as they are stored."""
    a = C.encode_signed(F.when(F.col("n_cmp") % 5 != 0, F.col("pc")), C.SLOPE_MAX)
    raw = dems.select("dem_id", a.alias("a"), C.encode_signed(F.col("pb") * 1000, C.SLOPE_MAX).alias("b"))
    return raw.select("dem_id", C.sum_raw("a", "b").alias("raw"))


# --- filters and projections -----------------------------------------------------------------------------

@query("pts", "SELECT pid, x, y FROM pts WHERE x BETWEEN floor(10.3) AND ceil(20.6) AND y BETWEEN floor(5.7) AND ceil(17.2)")
def f09_geocell_filter(pts):
    """Whole cells around the bounds."""
    return pts.where(F.col("x").between(F.floor(F.lit(10.3)), F.ceil(F.lit(20.6))) & F.col("y").between(F.floor(F.lit(5.7)), F.ceil(F.lit(17.2)))).select("pid", "x", "y")


WITH_NULLS = "n AS (SELECT r, c, CASE WHEN slope > 10 THEN ref_z END AS a, CASE WHEN slope < 40 THEN ref_z*2 END AS b, CASE WHEN stable THEN slope END AS d FROM ref)"


def with_nulls(ref):
    return ref.select("r", "c", F.when(F.col("slope") > 10, F.col("ref_z")).alias("a"), F.when(F.col("slope") < 40, F.col("ref_z") * 2).alias("b"), F.when(F.col("stable"), F.col("slope")).alias("d"))


DROPPED = "SELECT r, c, 'any' AS how FROM n WHERE a IS NOT NULL AND b IS NOT NULL AND d IS NOT NULL UNION ALL SELECT r, c, 'all' FROM n WHERE a IS NOT NULL OR d IS NOT NULL UNION ALL SELECT r, c, 'subset' FROM n WHERE a IS NOT NULL AND d IS NOT NULL"


@query("ref", DROPPED, WITH_NULLS)
def f10_dropna(ref):
    """Rows with any null, with nothing but nulls in a subset, with any in a subset."""
    n = with_nulls(ref)
    parts = {"any": n.dropna("any"), "all": n.dropna("all", subset=["a", "d"]), "subset": n.dropna("any", subset=["a", "d"])}
    return reduce(lambda x, y: x.unionByName(y), [df.select("r", "c", F.lit(how).alias("how")) for how, df in parts.items()])


def drop_null_columns(df):
    """The columns that hold a value; one pass counts all of them."""
    counts = df.agg(*(F.count(c).alias(c) for c in df.columns)).first().asDict()
    return df.select(*(c for c in df.columns if counts[c]))


@query("ref", "SELECT r, c, a, b, d FROM n", WITH_NULLS)
def f11_drop_null_columns(ref):
    return drop_null_columns(with_nulls(ref).withColumn("none", F.lit(None).cast("double")))


@query("obs", "SELECT ok, ln, coalesce(proba > 0.95::DOUBLE*255 OR z IS NULL OR z > 480, false) AS outlier FROM (SELECT ok, ln, proba, CASE WHEN tag THEN z END AS z FROM obs)")
def f21_extreme_outliers(obs):
    """Beyond the probability, without a value, or beyond the greatest height."""
    z = F.when(F.col("tag"), F.col("z"))
    return obs.select("ok", "ln", ((F.col("proba") > 0.95 * 255) | z.isNull() | F.coalesce(z > 480, F.lit(False))).alias("outlier"))


@query("series", "SELECT event_id, h FROM series WHERE CAST(json_extract(props, '$.k') AS INT) % 4 = 0 AND h IS NOT NULL")
def f22_quality_flag(series):
    """Rows whose quality flag, inside the record, is good."""
    return series.where((F.from_json("props", "k int")["k"] % 4 == 0) & F.col("h").isNotNull()).select("event_id", "h")


@query("dems", "SELECT region AS title, dem_id AS id, CAST(NULL AS DOUBLE) AS missing, pc AS dz FROM dems")
def p04_reindex(dems):
    """Columns renamed, dropped and put in a fixed order; one that isn't there is null."""
    df = dems.withColumnsRenamed({"region": "title", "dem_id": "id", "pc": "dz"}).drop("pa", "pb", "n_cmp")
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in ("title", "id", "missing", "dz")))


@query("obs", "SELECT r, c, z1995, z1996, z1997, v.yr AS yr, CASE v.yr WHEN 1995 THEN z1995 WHEN 1996 THEN z1996 ELSE z1997 END AS z FROM (SELECT r, c, round(median(z) FILTER (yr = 1995), 9) AS z1995, round(median(z) FILTER (yr = 1996), 9) AS z1996, round(median(z) FILTER (yr = 1997), 9) AS z1997 FROM obs GROUP BY r, c), (VALUES (1995), (1996), (1997)) v(yr)")
def p05_stack_unstack(obs):
    """Years as columns, and the columns as rows again."""
    years = [1995, 1996, 1997]
    wide = obs.groupBy("r", "c").pivot("yr", years).agg(F.round(F.median("z"), 9)).toDF("r", "c", *(f"z{y}" for y in years))
    each = F.explode(F.array(*(F.struct(F.lit(y).alias("yr"), F.col(f"z{y}").alias("z")) for y in years)))
    return wide.withColumn("e", each).select("*", "e.yr", "e.z").drop("e")


# --- joins -----------------------------------------------------------------------------------------------

@query("pts ref", "SELECT pid, ref_z FROM (SELECT pid, CAST(round_even((x*1.1::DOUBLE-0.5::DOUBLE), 0) AS INT) AS c, CAST(round_even((y*0.9::DOUBLE-0.5::DOUBLE), 0) AS INT) AS r FROM pts) JOIN ref USING (r, c)")
def j11_nearest_cell(pts, ref):
    """The cell whose centre is nearest on either axis; halfway goes to the even one."""
    near = lambda v, k: F.rint(F.col(v) * k - 0.5).cast("int")
    return pts.select("pid", near("x", 1.1).alias("c"), near("y", 0.9).alias("r")).join(ref.select("r", "c", "ref_z"), ["r", "c"]).select("pid", "ref_z")


@query("pts", "SELECT pid, x BETWEEN l AND r AND y BETWEEN b AND t AS inside FROM pts JOIN (VALUES ('BUILDING', 0, 0, 20, 25), ('MACHINERY', 10, 0, 40, 30), ('FURNITURE', 0, 10, 30, 60)) v(seg, l, b, r, t) USING (seg)")
def j18_region_by_name(pts):
    """Bounds looked up in a map of regions; rows of unknown regions go."""
    regions = F.create_map(*(x for k, v in M.REGIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    b = F.try_element_at(regions, F.col("seg"))
    return pts.withColumn("b", b).where("b is not null").select("pid", (F.col("x").between(F.col("b")[0], F.col("b")[2]) & F.col("y").between(F.col("b")[1], F.col("b")[3])).alias("inside"))


@query("obs", "SELECT a.r, a.c, a.yr, round(a.z - b.z, 9) AS dz FROM (SELECT r, c, yr, median(z) AS z FROM obs GROUP BY r, c, yr) a JOIN (SELECT r // 8 AS tr, c // 8 AS tc, yr, median(z) AS z FROM obs WHERE tag GROUP BY ALL) b ON a.r // 8 = tr AND a.c // 8 = tc AND a.yr = b.yr")
def j19_year_aligned(obs):
    """Each cell's year against the same year of its tile."""
    tr, tc = F.floor(F.col("r") / TILE).alias("tr"), F.floor(F.col("c") / TILE).alias("tc")
    tile = obs.where("tag").groupBy(tr, tc, "yr").agg(F.median("z").alias("t"))
    y = obs.groupBy("r", "c", "yr").agg(F.median("z").alias("z")).select("*", tr, tc)
    return y.join(tile, ["tr", "tc", "yr"]).select("r", "c", "yr", F.round(F.col("z") - F.col("t"), 9).alias("dz"))


# --- aggregates, windows, sorts --------------------------------------------------------------------------

@query("pts", "SELECT bin, round(1.4826::DOUBLE*median(abs(g-m)), 9) AS nmad, count(*) AS n FROM (SELECT *, median(g) OVER (PARTITION BY bin) AS m FROM (SELECT seg, CAST(floor(x/8.0) AS INT) AS bin, CAST(floor(y/5.0) AS INT) AS gap, avg(v) AS g FROM pts GROUP BY ALL)) GROUP BY bin")
def a24_nmad_of_gap_means(pts):
    """The mean of every gap, then the spread of the means by distance."""
    gap = pts.groupBy("seg", C.uniform_bin("x", 0, 8.0).alias("bin"), C.uniform_bin("y", 0, 5.0).alias("gap")).agg(F.avg("v").alias("g"))
    return exact_nmad(stored(gap, "gaps"), ["bin"], "g").select("bin", F.round("nmad", 9).alias("nmad"), "n")


PATCHES = "s AS (SELECT zone, round(avg(slope), 9) AS pred, round(median(ref_z), 9) AS bad, count(*) AS n, round(abs(avg(slope)*30 - median(ref_z)), 9) AS diff FROM ref GROUP BY zone HAVING count(*) > 5)"


def patch_summary(ref):
    s = ref.groupBy("zone").agg(F.avg("slope").alias("p"), F.median("ref_z").alias("b"), F.count("*").alias("n")).where("n > 5")
    return s.select("zone", F.round("p", 9).alias("pred"), F.round("b", 9).alias("bad"), "n", F.round(F.abs(F.col("p") * 30 - F.col("b")), 9).alias("diff"))


@query("ref", "SELECT * FROM s", PATCHES)
def a28_patch_summary(ref):
    """Mean prediction, median of the truth, size and difference of every patch of more than a few cells."""
    return patch_summary(ref)


@query("ref", "SELECT * FROM s ORDER BY diff DESC, zone LIMIT 20", PATCHES)
def t06_top_by_difference(ref):
    return patch_summary(ref).orderBy(F.desc("diff"), "zone").limit(20)


@query("obs", "SELECT r, c, CAST(to_timestamp(median(epoch(d))) AT TIME ZONE 'UTC' AS DATE)::VARCHAR AS d FROM obs WHERE tag GROUP BY r, c")
def a33_median_date(obs):
    """The median of the days of valid observations; between two days, the earlier's noon belongs to it."""
    mid = F.median(F.unix_date("d"))
    return obs.where("tag").groupBy("r", "c").agg(F.date_from_unix_date(F.floor(mid).cast("int")).cast("string").alias("d"))


WIDE = [(i, j) for i in range(-3, 4) for j in range(-3, 4)]


@query("ref", "SELECT a.r, a.c, count(*) AS n, round(avg(b.ref_z), 7) AS mean, max(b.slope) AS hi FROM ref a JOIN ref b ON abs(a.r-b.r) <= 3 AND abs(a.c-b.c) <= 3 GROUP BY a.r, a.c")
def w06_spatial_window(ref):
    """A square window around every cell, by shifted equi-joins; partial sums leave a row per cell and task."""
    seen = G.neighbours(ref.select("r", "c", "ref_z", "slope"), WIDE)
    got = seen.groupBy("r", "c").agg(F.count("*").alias("n"), F.round(F.avg("ref_z"), 7).alias("mean"), F.max("slope").alias("hi"))
    return got.join(ref.select("r", "c"), ["r", "c"], "left_semi")


@query("strips", "SELECT CAST(row_number() OVER (PARTITION BY status ORDER BY year(d) DESC, (x1-x0)*(y1-y0) DESC, strip) AS INT) AS place, status, strip FROM strips")
def t03_derived_sort(strips):
    """Order by the year, latest first, then by area."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return strips.select(F.row_number().over(W.partitionBy("status").orderBy(F.year("d").desc(), area.desc(), "strip")).alias("place"), "status", "strip")


SAMPLED = "SELECT pid, 'without' AS how, 1::BIGINT AS times FROM (SELECT pid FROM pts ORDER BY (pid*7919) % 10007, pid LIMIT 50) UNION ALL SELECT i.pid, 'with', count(*) FROM (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS k, count(*) OVER () AS n FROM pts) i JOIN range(80) t(j) ON k = (j*104729 + 17) % n GROUP BY i.pid"


@query("pts", SAMPLED)
def t07_samples(pts):
    """Fifty points without replacement, by hash order; eighty draws with replacement, by place."""
    without = pts.orderBy((F.col("pid") * 7919) % 10007, "pid").limit(50).select("pid", F.lit("without").alias("how"), F.lit(1).cast("long").alias("times"))
    n = pts.count()
    drawn = sorted({(j * 104729 + 17) % n for j in range(80)}) if n else []
    times = {k: sum((j * 104729 + 17) % n == k for j in range(80)) for k in drawn}
    rank = numbered(pts.select("pid"), "pid")
    hits = pts.sparkSession.createDataFrame([(k, v) for k, v in times.items()], "k long, times long")
    return without.unionByName(rank.join(F.broadcast(hits), "k").select("pid", F.lit("with").alias("how"), "times"))


def numbered(df, key: str, width: int = 1024):
    """``k``: the rows' places in the order of a whole-number key, counted by ranges of keys, by ranges of these, and within them: the
    one window without a partition has a row per ``width`` squared keys."""
    part = F.floor(F.col(key) / width)
    counts = df.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).withColumn("_q", F.floor(F.col("_p") / width))
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    large = counts.groupBy("_q").agg(F.sum("_n").alias("_m")).withColumn("_b", before(W.orderBy("_q"), "_m")).drop("_m")
    ahead = counts.withColumn("_a", before(W.partitionBy("_q").orderBy("_p"), "_n")).join(large, "_q").select("_p", (F.col("_a") + F.col("_b")).alias("_a"))
    within = F.row_number().over(W.partitionBy("_p").orderBy(key)) - 1
    return df.withColumn("_p", part).withColumn("_w", within).join(ahead, "_p").withColumn("k", F.col("_w") + F.col("_a")).drop("_p", "_w", "_a")


@query("pts", "SELECT pid, CASE WHEN (pid*7919) % 4 = 0 THEN 'test' ELSE 'train' END AS part FROM pts")
def t10_split_rows(pts):
    """Three quarters to train, one to test, by hash."""
    return pts.select("pid", F.when((F.col("pid") * 7919) % 4 == 0, "test").otherwise("train").alias("part"))
