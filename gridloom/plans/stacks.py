"""Masks, stacks, filters and aggregates."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.functions import columns as C
from gridloom.operators import grid as G
from gridloom.operators.quantiles import exact_nmad, exact_quantiles
from gridloom.operators.solvers import first_of_each, replicated
from gridloom.plans.registry import query
from gridloom.sources.files import stored

MASKED = "masked AS (SELECT r, c, dem_id, d, yr, day_code, CASE WHEN tag AND proba <= 127 THEN greatest(-1500.0::DOUBLE, least(1500.0::DOUBLE, z)) END AS z FROM obs)"


def stack_sql(keys: str, src: str, digits: int = 9) -> str:
    """Median, NMAD, count and day code by ``keys``."""
    return (f"SELECT {keys}, round(median(z), {digits}) AS median, round(1.4826::DOUBLE*median(abs(z-m)), {digits}) AS nmad, count(z) AS n, CAST(coalesce(trunc(median(CASE WHEN z IS NOT NULL THEN day_code END)),0) AS INT) AS day_code "
            f"FROM (SELECT *, median(z) OVER (PARTITION BY {keys}) AS m FROM {src}) GROUP BY {keys}")  # fmt: skip


def masked(obs, threshold: float = 0.5, limit: float = 1500.0):
    """Match tag, outlier probability (missing counts as 255) and clip; what is masked is null, rows stay."""
    keep = F.coalesce("tag", F.lit(False)) & (F.coalesce("proba", F.lit(255.0)) <= int(threshold * 255))
    return obs.withColumn("z", F.when(keep, C.clip("z", -limit, limit)))


def yearly(df, keys, digits=9):
    day = F.coalesce(F.median(F.when(F.col("z").isNotNull(), F.col("day_code"))).cast("int"), F.lit(0)).alias("day_code")
    out = G.robust_stack(df, keys, "z", day)
    return out.select(*keys, F.round("median", digits).alias("median"), F.round("nmad", digits).alias("nmad"), "n", "day_code")


@query("obs", stack_sql("r, c, yr", "masked"), MASKED)
def a01_yearly_median(obs):
    """A1-A4: exact median, NMAD, count and day code of masked observations by cell and year."""
    return yearly(masked(obs), ["r", "c", "yr"])


@query("obs dems", stack_sql("r, c, yr", "moved", 6), MASKED, "moved AS (SELECT r, c, yr, day_code, z + CASE WHEN n_cmp > 60 THEN (pa*(c-20.0)+pb*(r-25.0)+pc) ELSE 0.0 END AS z FROM masked JOIN dems USING (dem_id))")
def r01_plane_corrected_stack(obs, dems):
    """Clip, masks, then the plane of those strips that have more than 60 comparisons."""
    plane = C.plane(F.col("c").cast("double"), F.col("r").cast("double"), "pa", "pb", "pc", F.lit(20.0), F.lit(25.0))
    df = masked(obs).join(G.checked_broadcast(dems.select("dem_id", "pa", "pb", "pc", "n_cmp")), "dem_id")
    return yearly(df.withColumn("z", F.col("z") + F.when(F.col("n_cmp") > 60, plane).otherwise(0.0)), ["r", "c", "yr"], 6)


#: Fixed values of the four stacked products: largest value (others are held to it), whether the match tag and the plane count.
PRODUCTS = {"dhdt": (250.0, False, False), "dem": (1500.0, True, False), "dem_noncoreg": (1500.0, False, False), "dem_vertcoreg": (1500.0, True, True)}
CLIPPED = "p AS (SELECT r, c, yr, {product!r} AS product, greatest(-{v}::DOUBLE, least({v}::DOUBLE, z)) {plane} AS z FROM obs {join} WHERE proba <= 127 {tag})"
ALL_PRODUCTS = "p AS (" + " UNION ALL ".join(
    CLIPPED.format(product=k, v=v, plane="+ pa*(r-20) + pb*(c-20) + pc" if plane else "", join="JOIN dems USING (dem_id)" if plane else "", tag="AND tag" if tag else "")[len("p AS ("):-1]
    for k, (v, tag, plane) in PRODUCTS.items()
) + ")"


@query("obs dems", "SELECT product, r, c, yr, round(median(z), 9) AS median, count(z) AS n FROM p GROUP BY product, r, c, yr", ALL_PRODUCTS)
def r01b_median_stacks(obs, dems):
    """The four products of the median stack: held to their limit, with or without match tag, the last with its strip's plane."""
    base = obs.where("proba <= 127").select("r", "c", "yr", "dem_id", "z", "tag")
    planes = dems.select("dem_id", "pa", "pb", "pc")
    parts = []
    for name, (limit, tag, plane) in PRODUCTS.items():
        z, df = C.clip("z", -limit, limit), base.where("tag") if tag else base
        if plane:
            df = df.join(G.checked_broadcast(planes), "dem_id")
            z = z + F.col("pa") * (F.col("r") - 20) + F.col("pb") * (F.col("c") - 20) + F.col("pc")
        parts.append(df.select(F.lit(name).alias("product"), "r", "c", "yr", z.alias("z")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("product", "r", "c", "yr").agg(F.round(F.median("z"), 9).alias("median"), F.count("z").alias("n"))


@query("obs dems", "SELECT r, c, yr, count(*) AS n FROM obs WHERE NOT EXISTS (SELECT 1 FROM dems WHERE dems.dem_id = obs.dem_id AND n_cmp < 15) GROUP BY r, c, yr")
def j07_exclude_titles(obs, dems):
    return obs.join(dems.where("n_cmp < 15"), "dem_id", "left_anti").groupBy("r", "c", "yr").agg(F.count("*").alias("n"))


@query("obs dems", "SELECT dem_id, region FROM dems WHERE EXISTS (SELECT 1 FROM obs WHERE obs.dem_id = dems.dem_id AND tag AND proba <= 20)")
def j08_titles_with_mask(obs, dems):
    return dems.join(obs.where("tag and proba <= 20"), "dem_id", "left_semi").select("dem_id", "region")


@query("obs dems", "SELECT r, c, CAST(d AS VARCHAR) AS d, ok, ln, round(z + pa*(c-20.0)+pb*(r-25.0)+pc, 9) AS z FROM obs JOIN dems USING (dem_id) WHERE n_cmp > 60")
def j09_coefficient_lookup(obs, dems):
    planes = dems.where("n_cmp > 60").select("dem_id", "pa", "pb", "pc")
    z = F.col("z") + F.col("pa") * (F.col("c") - 20.0) + F.col("pb") * (F.col("r") - 25.0) + F.col("pc")
    return obs.join(G.checked_broadcast(planes), "dem_id").select("r", "c", F.col("d").cast("string").alias("d"), "ok", "ln", F.round(z, 9).alias("z"))


@query("pts", "SELECT pid, x, y, v FROM pts WHERE x BETWEEN 5.5 AND 20.5 AND y BETWEEN 2.5 AND 30.5")
def f01_bbox_points(pts):
    return pts.where(F.col("x").between(5.5, 20.5) & F.col("y").between(2.5, 30.5)).select("pid", "x", "y", "v")


BOX = "SELECT strip FROM strips WHERE x0 {0} 20 AND x1 {1} 10 AND y0 {0} 30 AND y1 {1} 15"


def _box(strips, over):
    box = strips
    for name, v in (("bx0", 10.0), ("by0", 15.0), ("bx1", 20.0), ("by1", 30.0)):
        box = box.withColumn(name, F.lit(v))
    return box.where(over("", "b")).select("strip")


@query("strips", BOX.format("<", ">"))
def f02_open_overlap(strips):
    return _box(strips, C.overlap_open)


@query("strips", BOX.format("<=", ">="))
def f03_closed_overlap(strips):
    return _box(strips, C.overlap_closed)


@query("strips", "SELECT strip FROM strips WHERE (x0 <= 20 AND x1 >= 10 AND y0 <= 30 AND y1 >= 15) AND NOT (x0 < 20 AND x1 > 10 AND y0 < 30 AND y1 > 15)")
def f05_touches(strips):
    return _box(strips, lambda a, b: C.overlap_closed(a, b) & ~C.overlap_open(a, b))


@query("pts", "SELECT pid, x, y FROM pts WHERE ((y < 30 AND y > 2 AND x > 3 AND x < 37 - (y-2)) )")
def f04_point_in_polygon(pts):
    """even-odd test against a ring; the oracle has the same quadrilateral as half planes."""
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((3.0, 2.0), (37.0, 2.0), (9.0, 30.0), (3.0, 30.0))))
    return pts.where(C.in_ring("x", "y", ring)).select("pid", "x", "y")


@query("strips", "SELECT strip, CAST(d AS VARCHAR) AS d FROM strips WHERE year(d) IN (1996, 1998)")
def f07_year_filter(strips):
    return strips.where(F.year("d").isin(1996, 1998)).select("strip", F.col("d").cast("string").alias("d"))


@query("dems", "SELECT dem_id, region FROM dems WHERE contains(region, '1') OR ends_with(region, '3') OR region LIKE 'C%'")
def f08_substring_filter(dems):
    return dems.where(F.col("region").contains("1") | F.col("region").endswith("3") | F.col("region").rlike("^C")).select("dem_id", "region")


@query("obs", "SELECT r, c, yr, count(*) AS total, count(z) AS kept FROM masked GROUP BY r, c, yr HAVING count(z) > 1", MASKED)
def f12_more_than_one_valid(obs):
    """Masked cells stay as rows, then those with more than one valid value."""
    return masked(obs).groupBy("r", "c", "yr").agg(F.count("*").alias("total"), F.count("z").alias("kept")).where("kept > 1")


@query("obs", "SELECT ok, ln, e FROM (SELECT *, median(abs(v)) OVER () AS mv FROM (SELECT ok, ln, a+0.01 AS e, z-500 AS v, median(a+0.01) OVER () AS me FROM obs) WHERE e < 3*me*0.4) WHERE abs(v) < 3*mv*0.4")
def f19_robust_threshold(obs):
    """errors under a multiple of their median, then values under one of the median of what is left."""
    rows = obs.select("ok", "ln", (F.col("a") + 0.01).alias("e"), (F.col("z") - 500).alias("v"))
    one = lambda df, value, name: F.broadcast(exact_quantiles(df, [], value, {name: 0.5}).select(name))  # noqa: E731  one row
    first = rows.join(one(rows, "e", "me"), how="cross").where("e < 3*me*0.4").drop("me").withColumn("w", F.abs("v"))
    return first.join(one(first, "w", "mw"), how="cross").where("w < 3*mw*0.4").select("ok", "ln", "e")


@query("ref", "SELECT r, c FROM ref, (SELECT quantile_cont(ref_z, 0.01) AS z0, quantile_cont(ref_z, 0.99) AS z1, quantile_cont(slope, 0.01) AS s0, quantile_cont(slope, 0.99) AS s1 FROM ref WHERE NOT stable) WHERE (ref_z > z0 AND ref_z < z1) OR (slope > s0 AND slope < s1)")
def f20_percentile_band(ref):
    """within the 1-99 % band of the unstable cells in any of two attributes."""
    unstable = ref.where(~F.col("stable"))
    band = lambda v, x: F.broadcast(exact_quantiles(unstable, [], v, {f"{x}0": 0.01, f"{x}1": 0.99}).drop("n"))  # noqa: E731  one row
    both = ref.join(band("ref_z", "z"), how="cross").join(band("slope", "s"), how="cross")
    return both.where("(ref_z > z0 and ref_z < z1) or (slope > s0 and slope < s1)").select("r", "c")


@query("series", "SELECT event_id, track, h FROM series WHERE abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) < 172800000000 OR user_id % 10 = 0")
def f23_time_or_flag(series):
    near = F.abs(F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-15").cast("timestamp"))) < 172_800_000_000
    return series.where(near | (F.col("user_id") % 10 == 0)).select("event_id", "track", "h")


@query("obs ref", "SELECT ok, ln, round(z - ref_z, 9) AS dh, round((z - ref_z) / nullif(round(year(d) + month(d)/12.0::DOUBLE + day(d)/360.0::DOUBLE - (1995 + 8/12.0::DOUBLE), 9), 0), 7) AS dhdt FROM obs JOIN ref USING (r, c)")
def r12_dh_dhdt(obs, ref):
    """Difference to the reference and rate per decimal year."""
    dt = F.round(C.decimal_year("d") - (1995 + 8 / 12), 9)
    df = obs.join(ref.select("r", "c", "ref_z"), ["r", "c"]).withColumn("dh", F.col("z") - F.col("ref_z"))
    return df.select("ok", "ln", F.round("dh", 9).alias("dh"), F.round(F.try_divide("dh", dt), 7).alias("dhdt"))


@query("obs", "SELECT CAST(floor(r/4.0) AS INT) AS br, CAST(floor(c/4.0) AS INT) AS bc, yr, round(median(z),9) AS median, count(z) AS n, round(stddev_pop(z), 6) AS std FROM obs GROUP BY 1, 2, 3")
def a05_block_yearly_stats(obs):
    block = [F.floor(F.col("r") / 4.0).cast("int").alias("br"), F.floor(F.col("c") / 4.0).cast("int").alias("bc"), "yr"]
    return obs.groupBy(*block).agg(F.round(F.median("z"), 9).alias("median"), F.count("z").alias("n"), F.round(F.stddev_pop("z"), 6).alias("std"))


@query("pts", "SELECT xb, yb, round(median(v),9) AS v, round(median(x),9) AS x, count(v) AS n FROM (SELECT *, CAST(floor(x/5.0) AS INT) AS xb, CAST(floor(y/5.0) AS INT) AS yb FROM pts) GROUP BY xb, yb")
def a06_grid_median(pts):
    return pts.groupBy(C.uniform_bin("x", 0, 5.0).alias("xb"), C.uniform_bin("y", 0, 5.0).alias("yb")).agg(F.round(F.median("v"), 9).alias("v"), F.round(F.median("x"), 9).alias("x"), F.count("v").alias("n"))


@query("obs", "SELECT r, c, n FROM (SELECT *, median(n) OVER () AS m FROM (SELECT r, c, count(*) AS n FROM obs GROUP BY r, c)) WHERE n/m > 1.2")
def a07_relative_count_having(obs):
    n = obs.groupBy("r", "c").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.median("n").alias("m"))), how="cross").where("n / m > 1.2").select("r", "c", "n")


CUBE_SQL = """, e AS (SELECT dem_id, z - ref_z AS e, CASE WHEN slope < 10 THEN 0 WHEN slope < 25 THEN 1 ELSE 2 END AS sb, CASE WHEN ref_z < 930 THEN 0 WHEN ref_z < 965 THEN 1 ELSE 2 END AS zb FROM obs JOIN ref USING (r, c)),
g AS (SELECT sb, zb, e FROM e UNION ALL SELECT sb, NULL, e FROM e UNION ALL SELECT NULL, zb, e FROM e UNION ALL SELECT NULL, NULL, e FROM e)
SELECT sb, zb, count(e) AS n, round(1.4826::DOUBLE*median(abs(e-m)), 9) AS nmad FROM (SELECT *, median(e) OVER (PARTITION BY sb, zb) AS m FROM g) GROUP BY sb, zb"""


@query("obs ref", CUBE_SQL)
def a08_binned_error_cube(obs, ref):
    """Count and NMAD in all combinations of bins. Binned medians come first, so residuals are one pass more."""
    e = obs.join(ref, ["r", "c"]).select((F.col("z") - F.col("ref_z")).alias("e"), C.digitise("slope", [10, 25]).alias("sb"), C.digitise("ref_z", [930, 965]).alias("zb"))
    e = stored(e, "residuals")
    sets = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (True, False) for b in (True, False))))
    g = e.withColumn("s", sets).select("e", F.when(F.col("s.a"), F.col("sb")).alias("sb"), F.when(F.col("s.b"), F.col("zb")).alias("zb"))
    return exact_nmad(g, ["sb", "zb"], "e").select("sb", "zb", "n", F.round("nmad", 9).alias("nmad"))


@query("obs ref", "SELECT yr, CAST(floor(ref_z/20.0) AS INT) AS band, round(median(z-ref_z),8) AS dh, round(quantile_cont(z-ref_z, 0.25),7) AS q25, round(quantile_cont(z-ref_z, 0.75),7) AS q75, count(*) AS n FROM obs JOIN ref USING (r, c) GROUP BY 1, 2")
def a09_hypsometric_bands(obs, ref):
    df = obs.join(ref.select("r", "c", "ref_z"), ["r", "c"])
    dh = stored(df.select("yr", C.uniform_bin("ref_z", 0, 20.0).alias("band"), (F.col("z") - F.col("ref_z")).alias("dh")), "differences")
    q = exact_quantiles(dh, ["yr", "band"], "dh", {"mid": 0.5, "q25": 0.25, "q75": 0.75})
    return q.select("yr", "band", F.round("mid", 8).alias("dh"), F.round("q25", 7).alias("q25"), F.round("q75", 7).alias("q75"), "n")


@query("obs ref", "SELECT yr, round(0.85*sum(dh*area)/sum(area), 6) AS mean_dh FROM (SELECT yr, CAST(floor(ref_z/20.0) AS INT) AS band, median(z-ref_z) AS dh, count(DISTINCT r*1000+c) AS area FROM obs JOIN ref USING (r, c) GROUP BY 1, 2) GROUP BY yr")
def a10_area_weighted_mean(obs, ref):
    df = obs.join(ref.select("r", "c", "ref_z"), ["r", "c"])
    band = C.uniform_bin("ref_z", 0, 20.0).alias("band")
    dh = stored(df.select("yr", band, "r", "c", (F.col("z") - F.col("ref_z")).alias("dh")), "differences")
    area = dh.groupBy("yr", "band").agg(F.countDistinct(F.col("r") * 1000 + F.col("c")).alias("area"))
    bands = exact_quantiles(dh, ["yr", "band"], "dh", {"mid": 0.5}).select("yr", "band", F.col("mid").alias("dh")).join(area, ["yr", "band"])
    return bands.groupBy("yr").agg(F.round(0.85 * F.sum(F.col("dh") * F.col("area")) / F.sum("area"), 6).alias("mean_dh"))


def scatter(x: str) -> str:
    """An expression, the same in both dialects, that scatters whole numbers over 0 .. 2^31 - 2."""
    return f"((({x}) % 2147483648) * 1103515245 + 12345) % 2147483648"


def fold(u: str) -> str:
    return f"(cast(floor({u} / 65536.0) as bigint) * ({u} % 65536) + {u}) % 2147483647"


BOOT_DRAW = "b * 7919 + j * 104729 + cast(yr as bigint) * 15485863"
BOOT_CTES = (
    "bands AS (SELECT CAST(floor(ref_z/20.0) AS INT) AS band, count(*) AS area FROM ref GROUP BY 1)",
    "v AS (SELECT yr, d, CAST(floor(ref_z/20.0) AS INT) AS band, median(z-ref_z) AS dh FROM obs JOIN ref USING (r, c) GROUP BY ALL)",
    "days AS (SELECT yr, d, row_number() OVER (PARTITION BY yr ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY yr) AS n FROM (SELECT DISTINCT yr, d FROM v))",
    "years AS (SELECT yr, n, greatest(n // 2, 3) AS k, CASE n WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 4 WHEN 5 THEN 10 WHEN 6 THEN 20 WHEN 7 THEN 35 ELSE 50 END AS m FROM (SELECT DISTINCT yr, n FROM days))",
    f"u AS (SELECT yr, n, b, {scatter(BOOT_DRAW)} AS u FROM years, range(50) t(b), range(200) s(j) WHERE b < m AND j < k)",
    f"draws AS (SELECT yr, b, {fold('u')} % n AS i FROM u)",
    "per AS (SELECT yr, b, band, median(dh) AS dh FROM draws JOIN days USING (yr, i) JOIN v USING (yr, d) GROUP BY ALL)",
    "smb AS (SELECT yr, b, 0.85*sum(dh*area)/(SELECT sum(area) FROM bands) AS s FROM per JOIN bands USING (band) GROUP BY yr, b)",
)


@query("obs ref", "SELECT yr, count(*) AS n, round(median(s), 8) AS med, round(quantile_cont(s, 0.25)+0.06, 7) AS q25, round(quantile_cont(s, 0.75)+0.06, 7) AS q75 FROM smb GROUP BY yr", *BOOT_CTES)
def a11_bootstrap_whole(obs, ref):
    """A11 over all rows: a year's n days are drawn with replacement, min(C(n,k), 50) times k = max(n // 2, 3) of them; of each
    resample the bands' medians over its days, weighted by the bands' area; median and quantiles (with the offset) by year.

    All rows go into medians by day and band; what is drawn from are a year's days, 366 at most at any scale.
    """
    band = C.uniform_bin("ref_z", 0, 20.0)
    bands = ref.groupBy(band.alias("band")).agg(F.count("*").alias("area"))
    v = obs.join(ref.select("r", "c", "ref_z"), ["r", "c"]).groupBy("yr", "d", band.alias("band")).agg(F.median(F.col("z") - F.col("ref_z")).alias("dh"))
    w = W.partitionBy("yr")
    days = v.select("yr", "d").distinct().select("yr", "d", (F.row_number().over(w.orderBy("d")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    times = F.expr("case n when 1 then 0 when 2 then 0 when 3 then 1 when 4 then 4 when 5 then 10 when 6 then 20 when 7 then 35 else 50 end")
    years = days.select("yr", "n").distinct().withColumn("m", times).where("m > 0")
    u = years.withColumn("b", F.explode(F.expr("sequence(0L, m - 1L)"))).withColumn("j", F.explode(F.expr("sequence(0L, greatest(n div 2, 3L) - 1L)"))).withColumn("u", F.expr(scatter(BOOT_DRAW)))
    draws = u.select("yr", "b", F.expr(f"{fold('u')} % n").alias("i"))
    per = draws.join(days.select("yr", "i", "d"), ["yr", "i"]).join(v, ["yr", "d"]).groupBy("yr", "b", "band").agg(F.median("dh").alias("dh"))
    total = bands.agg(F.sum("area").alias("total"))
    smb = per.join(bands, "band").groupBy("yr", "b").agg(F.sum(F.col("dh") * F.col("area")).alias("s")).join(F.broadcast(total)).select("yr", (F.col("s") * 0.85 / F.col("total")).alias("s"))
    q = lambda p: F.round(F.percentile("s", F.lit(p)) + 0.06, 7)
    return smb.groupBy("yr").agg(F.count("*").alias("n"), F.round(F.median("s"), 8).alias("med"), q(0.25).alias("q25"), q(0.75).alias("q75"))


@query("obs ref", "SELECT ok, ln, round(z - median(CASE WHEN stable THEN z - ref_z END) OVER (PARTITION BY yr), 8) AS z FROM obs JOIN ref USING (r, c)")
def a12_stable_bias_removed(obs, ref):
    """The yearly median over stable cells is a table of years, joined back; no window over a year."""
    df = obs.join(ref.select("r", "c", "ref_z", "stable"), ["r", "c"])
    stable = stored(df.where("stable").select("yr", (F.col("z") - F.col("ref_z")).alias("dz")), "stable")  # read three times
    bias = exact_quantiles(stable, ["yr"], "dz", {"bias": 0.5}).select("yr", "bias")
    return df.join(F.broadcast(bias), "yr", "left").select("ok", "ln", F.round(F.col("z") - F.col("bias"), 8).alias("z"))


@query("ref", "SELECT CAST(floor(r/2.0) AS INT) AS r, CAST(floor(c/2.0) AS INT) AS c, round(avg(ref_z), 6) AS z, count(*) AS n FROM ref GROUP BY 1, 2")
def a13_overview_mean(ref):
    return ref.groupBy(F.floor(F.col("r") / 2.0).cast("int").alias("r"), F.floor(F.col("c") / 2.0).cast("int").alias("c")).agg(F.round(F.avg("ref_z"), 6).alias("z"), F.count("*").alias("n"))


@query("obs", "SELECT count(z) AS n, round(median(z),9) AS median, min(z) AS lo, max(z) AS hi, round(avg(z),5) AS mean, round(var_pop(z),3) AS var, round(quantile_cont(z,0.95),7) AS p95 FROM masked", MASKED)
def a14_global_stats(obs):
    z, df = "z", masked(obs)
    plain = df.agg(F.min(z).alias("lo"), F.max(z).alias("hi"), F.round(F.avg(z), 5).alias("mean"), F.round(F.var_pop(z), 3).alias("var"))
    ranks = exact_quantiles(df, [], z, {"median": 0.5, "p95": 0.95}).select("n", F.round("median", 9).alias("median"), F.round("p95", 7).alias("p95"))
    return plain.join(F.broadcast(ranks), how="cross").select("n", "median", "lo", "hi", "mean", "var", "p95")  # one row each


@query("obs", "SELECT dem_id, yr, count(*) AS n FROM obs GROUP BY dem_id, yr HAVING count(*) > 5")
def a15_counts(obs):
    return obs.groupBy("dem_id", "yr").agg(F.count("*").alias("n")).where("n > 5")


CODES = "codes AS (SELECT r, c, yr, CASE WHEN median(z) < 300 THEN 1 WHEN median(z) < 450 THEN 2 WHEN median(z) < 600 THEN 3 ELSE 4 END AS code FROM obs GROUP BY r, c, yr)"


@query("obs", "SELECT r, c, CAST(arg_max(code, n*10 - code) AS INT) AS mode FROM (SELECT r, c, code, count(*) AS n FROM codes GROUP BY r, c, code) GROUP BY r, c", CODES)
def a16_quality_mode(obs):
    """The most frequent code of a cell's years, the lowest of equals."""
    m = obs.groupBy("r", "c", "yr").agg(F.median("z").alias("m")).withColumn("code", C.digitise("m", [300, 450, 600]) + 1)
    n = m.groupBy("r", "c", "code").agg(F.count("*").alias("n"))
    return n.groupBy("r", "c").agg(F.max_by("code", F.struct("n", -F.col("code"))).alias("mode"))


VOTES = """SELECT dem_id, n_out, n_in, n_in < 3 AS bad, true AS bad_strict FROM (SELECT dem_id, count_if(z < m - 400 OR z > m + 400)::BIGINT AS n_out, count_if(z >= m - 400 AND z <= m + 400)::BIGINT AS n_in
FROM obs JOIN (SELECT r, c, median(z) AS m FROM obs GROUP BY r, c) USING (r, c) GROUP BY dem_id) WHERE n_out >= 1"""


@query("obs", VOTES)
def a20_title_vote(obs):
    """Every cell has a range of its own; a title out of one is bad unless three values of it lie within theirs, in the stricter
    product in any case."""
    cells = obs.groupBy("r", "c").agg(F.median("z").alias("m")).select("r", "c", (F.col("m") - 400).alias("lo"), (F.col("m") + 400).alias("hi"))
    seen = obs.select("r", "c", "dem_id", "z").join(cells, ["r", "c"])
    off = (F.col("z") < F.col("lo")) | (F.col("z") > F.col("hi"))
    v = seen.groupBy("dem_id").agg(F.count_if(off).alias("n_out"), F.count_if(~off).alias("n_in"))
    return v.where("n_out >= 1").select("dem_id", "n_out", "n_in", (F.col("n_in") < 3).alias("bad"), F.lit(True).alias("bad_strict"))


@query("obs", "SELECT dem_id, CAST(sum(k - 1) AS BIGINT) AS n FROM (SELECT dem_id, count(*) OVER (PARTITION BY r, c) AS k FROM obs) GROUP BY dem_id")
def a21_comparison_count(obs):
    cells = obs.groupBy("r", "c").agg(F.count("*").alias("k"))
    return obs.select("r", "c", "dem_id").join(cells, ["r", "c"]).groupBy("dem_id").agg(F.sum(F.col("k") - 1).alias("n"))


@query("obs", "SELECT dem_id, round(median(z - m), 8) AS off FROM (SELECT dem_id, z, median(z) OVER (PARTITION BY r, c) AS m FROM obs) GROUP BY dem_id HAVING abs(median(z - m)) > 10")
def a22_dem_rejection(obs):
    res = G.with_group_median(obs.select("r", "c", "dem_id", "z"), ["r", "c"], "z", "m")
    return res.groupBy("dem_id").agg(F.median(F.col("z") - F.col("m")).alias("off")).where("abs(off) > 10").select("dem_id", F.round("off", 8).alias("off"))


@query("strips", "SELECT status, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM strips GROUP BY status")
def a23_total_bounds(strips):
    return strips.groupBy("status").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query("pts", "SELECT bin, round(1.4826::DOUBLE*median(abs(v-m)),9) AS nmad, count(*) AS n FROM (SELECT *, median(v) OVER (PARTITION BY bin) AS m FROM (SELECT CAST(floor(sqrt((x-20)*(x-20)+(y-15)*(y-15))/3.0) AS INT) AS bin, v FROM pts)) GROUP BY bin")
def a24_nmad_by_distance(pts):
    dx, dy = F.col("x") - 20, F.col("y") - 15
    binned = pts.select(C.uniform_bin(F.sqrt(dx * dx + dy * dy), 0, 3.0).alias("bin"), "v")
    return exact_nmad(binned, ["bin"], "v").select("bin", F.round("nmad", 9).alias("nmad"), "n")


#: Replicates of a variogram and points in each, as the reference takes them.
REPLICATES, REPLICATE_POINTS = 100, 500
REPLICATE_CTES = (
    f"h AS (SELECT *, {scatter('pid + rep * 7919')} AS u FROM pts, range({REPLICATES}) t(rep))",
    f"s AS (SELECT rep, pid, x, y, v FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY {fold('u')}, pid) AS k FROM h) WHERE k <= {REPLICATE_POINTS})",
    "p AS (SELECT a.rep, a.pid AS i, b.pid AS j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist, abs(a.v-b.v) AS dv FROM s a JOIN s b ON a.rep = b.rep AND a.pid < b.pid)",
    "g AS (SELECT rep, CAST(floor(dist/4.0) AS INT) AS bin, count(*) AS n, pow(2.198*median(dv),2)/2 AS gamma FROM p GROUP BY ALL)",
)


def replicate_pairs(pts):
    """All pairs within each of REPLICATES samples of REPLICATE_POINTS points (all points, where there are fewer)."""
    h = replicated(pts.select("pid", "x", "y", "v"), REPLICATES).withColumn("rep", F.col("rep").cast("long"))
    h = h.withColumn("u", F.expr(scatter("pid + rep * 7919"))).withColumn("u", F.expr(fold("u")))
    s = first_of_each(h, "rep", "u", 19, "pid", REPLICATE_POINTS).select("rep", "pid", "x", "y", "v")
    a, b = s.toDF("rep", "i", "ax", "ay", "av"), s.toDF("rep", "j", "bx", "by", "bv")
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return a.join(b, "rep").where("i < j").select("rep", "i", "j", F.sqrt(dx * dx + dy * dy).alias("dist"), F.abs(F.col("av") - F.col("bv")).alias("dv"))


def error_of(x: str):
    return F.stddev_samp(x) / F.sqrt(F.count(x))


@query("pts", "SELECT rep, CAST(sum(n) AS BIGINT) AS n, round(sum(d), 4) AS d FROM (SELECT rep, i, count(*) AS n, sum(dist) AS d FROM p GROUP BY rep, i) GROUP BY rep", *REPLICATE_CTES)
def j16_replicate_pairs(pts):
    """Number of pairs and their summed distance by replicate."""
    return replicate_pairs(pts).groupBy("rep").agg(F.count("*").alias("n"), F.round(F.sum("dist"), 4).alias("d"))


@query("pts", "SELECT bin, count(*) AS reps, round(avg(n), 6) AS n, round(stddev_samp(n)/sqrt(count(*)), 6) AS err FROM g GROUP BY bin", *REPLICATE_CTES)
def a25_replicate_histogram(pts):
    """Pairs by distance, mean and standard error over the replicates."""
    n = replicate_pairs(pts).groupBy("rep", C.uniform_bin("dist", 0, 4.0).alias("bin")).agg(F.count("*").alias("n"))
    return n.groupBy("bin").agg(F.count("*").alias("reps"), F.round(F.avg("n"), 6).alias("n"), F.round(error_of("n"), 6).alias("err"))


@query("pts", "SELECT bin, count(*) AS reps, CAST(sum(n) AS BIGINT) AS n, round(avg(gamma), 2) AS gamma, round(stddev_samp(gamma)/sqrt(count(*)), 2) AS err FROM g GROUP BY bin", *REPLICATE_CTES)
def a26_replicate_variogram(pts):
    """Dowd's estimate by replicate and distance, then its mean and standard error (sample deviation over the root of the
    number of replicates that have the bin; the library's own scaling isn't in the reference) by distance."""
    g = replicate_pairs(pts).groupBy("rep", C.uniform_bin("dist", 0, 4.0).alias("bin")).agg(F.count("*").alias("n"), (F.pow(2.198 * F.median("dv"), F.lit(2)) / 2).alias("gamma"))
    return g.groupBy("bin").agg(F.count("*").alias("reps"), F.sum("n").alias("n"), F.round(F.avg("gamma"), 2).alias("gamma"), F.round(error_of("gamma"), 2).alias("err"))


@query("ref", "SELECT zone, round(avg(CAST(stable AS INT)), 9) AS share, count(*) AS n FROM ref GROUP BY zone HAVING count(*) > 5")
def a30_stable_fraction(ref):
    return ref.groupBy("zone").agg(F.round(F.avg(F.col("stable").cast("int")), 9).alias("share"), F.count("*").alias("n")).where("n > 5")


@query("obs", "SELECT r, c, yr, CASE WHEN ocean THEN 0.0::DOUBLE ELSE z END AS z FROM (SELECT *, count_if(NOT ocean) OVER (PARTITION BY r, c) AS land FROM (SELECT r, c, yr, round(median(z),9) AS z, median(z) < 350 AS ocean FROM obs GROUP BY r, c, yr)) WHERE land >= 2")
def a31_ocean_filter(obs):
    y = obs.groupBy("r", "c", "yr").agg(F.median("z").alias("m")).withColumn("ocean", F.col("m") < 350)
    land = F.count_if(~F.col("ocean")).over(W.partitionBy("r", "c"))
    return y.withColumn("land", land).where("land >= 2").select("r", "c", "yr", F.when(F.col("ocean"), 0.0).otherwise(F.round("m", 9)).alias("z"))


@query("obs", "SELECT r, c, min(CASE WHEN tag THEN yr END) AS first, max(CASE WHEN tag THEN yr END) AS last FROM obs GROUP BY r, c")
def a32_usable_years(obs):
    y = F.when(F.col("tag"), F.col("yr"))
    return obs.groupBy("r", "c").agg(F.min(y).alias("first"), F.max(y).alias("last"))
