"""Trends with their errors, leave-one-out refits, seam blending, bracketing and further windows and codecs."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.functions import columns as C
from gridloom.operators import grid as G
from gridloom.operators.trends import robust_trend
from gridloom.plans.registry import query

YEARLY = "y AS (SELECT r, c, yr - 1995 AS t, median(z) AS z FROM obs GROUP BY r, c, yr)"


def yearly(obs):
    return obs.groupBy("r", "c", (F.col("yr") - 1995).alias("t")).agg(F.median("z").alias("z"))


def trend_sql(src: str, keys: str, to: str = "f") -> str:
    """CTEs that fit z over t by keys: n, b, a, sxx and the NMAD of residuals."""
    return (
        f"{to}0 AS (SELECT {keys}, count(*) AS n, regr_slope(z, t) AS b, regr_intercept(z, t) AS a, regr_sxx(z, t) AS sxx FROM {src} GROUP BY {keys} HAVING count(*) >= 2), "
        f"{to}1 AS (SELECT {keys}, z - b*t - a AS e FROM {src} JOIN {to}0 USING ({keys})), {to}2 AS (SELECT {keys}, median(e) AS m FROM {to}1 GROUP BY {keys}), "
        f"{to} AS (SELECT * FROM {to}0 JOIN (SELECT {keys}, 1.4826*median(abs(e-m)) AS nmad FROM {to}1 JOIN {to}2 USING ({keys}) GROUP BY {keys}) USING ({keys}))"
    )


def slope_error():
    return F.when(F.col("sxx") > 1e-12, F.col("nmad") / F.sqrt("sxx"))


@query("obs", "SELECT r, c, n, round(b, 9) AS slope, round(nmad/sqrt(sxx), 9) AS se FROM f", YEARLY, trend_sql("y", "r, c"))
def a18_slope_error(obs):
    """The slope of yearly medians and its standard error by the residuals' NMAD."""
    fit = G.linear_trend(yearly(obs), ["r", "c"], "t", "z").where("n >= 2")
    return fit.select("r", "c", "n", F.round("slope", 9).alias("slope"), F.round(slope_error(), 9).alias("se"))


ACCEL = "SELECT r, c, round((b1-b0)/6, 9) AS accel, round(sqrt(s0*s0+s1*s1)/6, 9) AS se FROM (SELECT r, c, max(b) FILTER (p = 0) AS b0, max(b) FILTER (p = 1) AS b1, max(nmad/sqrt(sxx)) FILTER (p = 0) AS s0, max(nmad/sqrt(sxx)) FILTER (p = 1) AS s1 FROM f GROUP BY r, c) WHERE b0 IS NOT NULL AND b1 IS NOT NULL"


@query("obs", ACCEL, YEARLY, "h AS (SELECT *, CAST(t >= 3 AS INT) AS p FROM y)", trend_sql("h", "r, c, p"))
def a19_acceleration(obs):
    """The change of slope between two periods, by one fit keyed by period."""
    fit = G.linear_trend(yearly(obs).withColumn("p", (F.col("t") >= 3).cast("int")), ["r", "c", "p"], "t", "z").where("n >= 2")
    at = lambda v, p, n: F.max(F.when(F.col("p") == p, v)).alias(n)
    two = fit.groupBy("r", "c").agg(at(F.col("slope"), 0, "b0"), at(F.col("slope"), 1, "b1"), at(slope_error(), 0, "s0"), at(slope_error(), 1, "s1")).where("b0 is not null and b1 is not null")
    return two.select("r", "c", F.round((F.col("b1") - F.col("b0")) / 6, 9).alias("accel"), F.round(F.sqrt(F.col("s0") * F.col("s0") + F.col("s1") * F.col("s1")) / 6, 9).alias("se"))


#: NMAD over which a cell's trend is fitted again without a year.
ROUGH = 1.5
FLAGGED = "q AS (SELECT r, c, yr - 1995 AS t, median(z)/100 AS z, CAST(1 + count(*) % 4 AS INT) AS flag FROM obs GROUP BY r, c, yr), y AS (SELECT r, c, t, CASE WHEN flag <> 3 OR good < 3 THEN z END AS z FROM (SELECT *, count_if(flag <> 3) OVER (PARTITION BY r, c) AS good FROM q))"
KEPT = "k AS (SELECT * FROM y WHERE z IS NOT NULL)"
LOO = f"""SELECT r, c, b['o'] AS left_out, b['k'] AS nmad FROM (SELECT DISTINCT r, c FROM y) LEFT JOIN
(SELECT r, c, list_reduce(list_prepend({{'k': round(f.nmad, 6), 'o': CAST(NULL AS BIGINT)}}, l), lambda a, x: CASE WHEN a['k'] > {ROUGH} AND x['k'] < a['k'] THEN x ELSE a END) AS b
FROM f LEFT JOIN (SELECT r, c, list({{'k': round(nmad, 6), 'o': CAST(o AS BIGINT)}} ORDER BY o) AS l FROM g GROUP BY r, c) USING (r, c)) USING (r, c)"""


def flagged(obs, scale: float):
    """Yearly values by cell with a quality flag from 1 to 4."""
    rows = G.by_cell(obs.select("r", "c", (F.col("yr") - 1995).alias("t"), "z"))
    return rows.groupBy("r", "c", "t").agg((F.median("z") / scale).alias("z"), (1 + F.count("*") % 4).alias("flag"))


def by_flags(q):
    """Values of flag 3 to null where a cell has three others."""
    good = F.count_if(F.col("flag") != 3).over(W.partitionBy("r", "c"))
    return q.withColumn("good", good).select("r", "c", "t", F.when((F.col("flag") != 3) | (F.col("good") < 3), F.col("z")).alias("z"))


@query("obs", LOO, FLAGGED, KEPT, trend_sql("k", "r, c"), "v AS (SELECT a.*, b.t AS o FROM k a JOIN k b USING (r, c) WHERE a.t <> b.t)", trend_sql("v", "r, c, o", "g"))
def r02_robust_trend(obs):
    """R2: observations of flag 3 go where three others are there. Then year by year: while the residuals' NMAD is over ROUGH,
    the refit without that year takes over if its NMAD is less; years after it has fallen to ROUGH aren't tried.

    Cells with under two observations have no trend.
    """
    y = by_flags(flagged(obs, 100.0))
    best = robust_trend(y, ["r", "c"], "t", "z", ROUGH)
    return y.select("r", "c").distinct().join(best, ["r", "c"], "left").select("r", "c", "left_out", "nmad")


REACH = 4
SEAM = f""", m AS (SELECT r, c, yr, tag, median(z) AS z, 1.4826::DOUBLE * median(abs(z - mid)) AS nmad, count(*) AS n, median(dayofyear(d)) AS doy FROM (SELECT *, median(z) OVER (PARTITION BY r, c, yr, tag) AS mid FROM obs) GROUP BY r, c, yr, tag),
w AS (SELECT a.r, a.c, greatest(0, 1 - sqrt(min((a.r-b.r)*(a.r-b.r)+(a.c-b.c)*(a.c-b.c)))/{REACH}) AS w FROM ref a JOIN ref b ON b.slope = 50 AND abs(a.r-b.r) < {REACH} AND abs(a.c-b.c) < {REACH} GROUP BY a.r, a.c),
k AS (SELECT r, c, yr, coalesce(w, 0) AS w, a.z AS za, a.nmad AS na, a.n AS ca, a.doy AS da, b.z AS zb, b.nmad AS nb, b.n AS cb, b.doy AS db FROM (SELECT * FROM m WHERE tag) a FULL JOIN (SELECT * FROM m WHERE NOT tag) b USING (r, c, yr) JOIN ref USING (r, c) LEFT JOIN w USING (r, c))
SELECT r, c, yr, round(CASE WHEN za IS NULL THEN zb WHEN zb IS NULL THEN za ELSE w*zb + (1-w)*za END, 9) AS z, round(CASE WHEN za IS NULL THEN nb WHEN zb IS NULL THEN na ELSE w*nb + (1-w)*na END, 4) AS nmad,
  greatest(coalesce(ca, 0), coalesce(cb, 0)) AS n, CASE WHEN za IS NULL THEN db WHEN zb IS NULL THEN da WHEN w >= 0.5 THEN db ELSE da END::DOUBLE AS doy FROM k"""


@query("ref obs", SEAM)
def r05_seam_blend(ref, obs):
    """Two stacks of every year blended by weights that fall from 1 inside a region to 0 at REACH cells: value and spread by weight,
    the greater count, the day of the side that weighs more; where one side is missing the other stands."""
    near = [(i, j) for i in range(1 - REACH, REACH) for j in range(1 - REACH, REACH)]
    seen = G.neighbours(ref.where("slope = 50").select("r", "c"), near)
    w = seen.groupBy("r", "c").agg(F.greatest(F.lit(0.0), 1 - F.sqrt(F.min(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc"))) / REACH).alias("w"))
    m = G.robust_stack(obs.select("r", "c", "yr", "tag", "z", "d"), ["r", "c", "yr", "tag"], "z", F.median(F.dayofyear("d")).alias("doy"))
    side = lambda tag, name: F.max(F.when(F.col("tag") == tag, F.struct(F.col("median").alias("z"), "nmad", "n", "doy"))).alias(name)
    k = m.groupBy("r", "c", "yr").agg(side(True, "a"), side(False, "b")).join(ref.select("r", "c"), ["r", "c"]).join(w, ["r", "c"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    mixed = lambda x: C.blend(F.col("a")[x], F.col("b")[x], F.col("w"))
    day = F.when(F.col("a").isNull(), F.col("b.doy")).when(F.col("b").isNull(), F.col("a.doy")).when(F.col("w") >= 0.5, F.col("b.doy")).otherwise(F.col("a.doy"))
    return k.select("r", "c", "yr", F.round(mixed("z"), 9).alias("z"), F.round(mixed("nmad"), 4).alias("nmad"), F.greatest(F.coalesce("a.n", F.lit(0)), F.coalesce("b.n", F.lit(0))).alias("n"), day.cast("double").alias("doy"))


BRACKET_ALL = "SELECT event_id, round(CASE WHEN t1 = t0 THEN 0 ELSE (epoch_us(ts)-t0)::DOUBLE/(t1-t0) END, 6) AS fraction FROM (SELECT event_id, ts, epoch_us(max(k) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING)) AS t0, epoch_us(min(k) OVER (PARTITION BY user_id ORDER BY ts DESC RANGE UNBOUNDED PRECEDING)) AS t1 FROM (SELECT *, CASE WHEN track = 'signup' THEN ts END AS k FROM series))"


@query("series", BRACKET_ALL)
def w08_bracket_all(series):
    """W8 over the whole table: how far every event lies between its user's signup events around it; null outside them."""
    u = F.unix_micros("ts")
    x = series.select("event_id", "user_id", u.alias("u"), F.when(F.col("track") == "signup", u).alias("k"))
    user = W.partitionBy("user_id")  # two running aggregates, one in either direction
    got = x.withColumn("t0", F.max("k").over(user.orderBy("u"))).withColumn("t1", F.min("k").over(user.orderBy(F.desc("u"))))
    return got.select("event_id", F.round(F.when(F.col("t0") == F.col("t1"), 0.0).otherwise(F.try_divide(F.col("u") - F.col("t0"), F.col("t1") - F.col("t0"))), 6).alias("fraction"))


@query("obs", "SELECT r, c, t, round(z - last_value(z) OVER (PARTITION BY r, c ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS dz FROM y", YEARLY)
def w09_offset_to_last(obs):
    last = F.last("z").over(W.partitionBy("r", "c").orderBy("t").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return yearly(obs).select("r", "c", "t", F.round(F.col("z") - last, 6).alias("dz"))


@query("dems", "SELECT dem_id, CAST(row_number() OVER (PARTITION BY region ORDER BY pc DESC, dem_id) AS INT) AS place FROM dems")
def w11_ordinals(dems):
    return dems.select("dem_id", F.row_number().over(W.partitionBy("region").orderBy(F.desc("pc"), "dem_id")).alias("place"))


@query("ref", "SELECT bin, round(m - lag(m) OVER (ORDER BY bin), 6) AS step FROM (SELECT CAST(floor(slope/5.0) AS INT) AS bin, avg(ref_z) AS m FROM ref GROUP BY 1)")
def w12_bin_steps(ref):
    """Differences from bin to bin; the window is over the bins, ten at any scale."""
    bins = ref.groupBy(C.uniform_bin("slope", 0, 5.0).alias("bin")).agg(F.avg("ref_z").alias("m"))
    return bins.select("bin", F.round(F.col("m") - F.lag("m").over(W.orderBy("bin")), 6).alias("step"))


@query("obs", "SELECT yr, count(*) AS n, round(avg(z), 6) AS mean FROM obs WHERE coalesce(proba, 255) <= CAST(floor(0.4*255) AS INT) GROUP BY yr")
def f16_probability_filter(obs):
    """F16: a missing probability counts as 255 and is rejected."""
    return obs.where(F.coalesce("proba", F.lit(255.0)) <= int(0.4 * 255)).groupBy("yr").agg(F.count("*").alias("n"), F.round(F.avg("z"), 6).alias("mean"))


@query("ref", "SELECT r, c, nullif(slope, 7) AS slope, round(CASE WHEN stable THEN ref_z END, 6) AS z, round(greatest(-1500, least(1500, ref_z*1.5)), 6) AS held FROM ref")
def f13_mask_and_clip(ref):
    """masking to null, a value that stands for null, clipping; no row is dropped."""
    return ref.select("r", "c", F.nullif(F.col("slope"), F.lit(7)).alias("slope"), F.round(F.when(F.col("stable"), F.col("ref_z")), 6).alias("z"), F.round(C.clip(F.col("ref_z") * 1.5, -1500.0, 1500.0), 6).alias("held"))


@query("ref", "SELECT r, c, CAST(greatest(0, least(254, trunc((v+1)*127))) AS INT) AS raw, round(CAST(greatest(0, least(254, trunc((v+1)*127))) AS INT)*2/254.0::DOUBLE - 1, 6) AS back FROM (SELECT r, c, (slope-25)/32.0::DOUBLE AS v FROM ref)")
def q03_correlation_codec(ref):
    raw = C.encode_correlation((F.col("slope") - 25) / F.lit(32.0))
    return ref.select("r", "c", raw.alias("raw"), F.round(C.decode_correlation(raw), 6).alias("back"))


@query("ref obs", "SELECT coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c, coalesce(a.z, b.z) AS z FROM (SELECT r, c, ref_z AS z FROM ref WHERE slope > 40) a FULL JOIN (SELECT r, c, round(median(z), 9) AS z FROM obs WHERE yr = 1995 GROUP BY r, c) b ON a.r = b.r AND a.c = b.c")
def s07_override(ref, obs):
    """Entries of the first relation override those of the second with the same key."""
    over = ref.where("slope > 40").select("r", "c", F.col("ref_z").alias("o"))
    base = obs.where("yr = 1995").groupBy("r", "c").agg(F.round(F.median("z"), 9).alias("z"))
    return base.join(over, ["r", "c"], "full").select("r", "c", F.coalesce("o", "z").alias("z"))


@query("ref", "SELECT r, c, round((0.001 + m)*ref_z/(slope + 0.001), 6) AS z FROM ref, (SELECT avg(slope) AS m FROM ref)")
def p06_standardise(ref):
    """Values scaled by their error against the mean error; the mean is one row."""
    mean = ref.agg(F.avg("slope").alias("m"))
    return ref.join(F.broadcast(mean)).select("r", "c", F.round((F.col("m") + 0.001) * F.col("ref_z") / (F.col("slope") + 0.001), 6).alias("z"))


@query("strips", "SELECT strip, status FROM strips WHERE status = 'F' UNION ALL SELECT strip, status FROM strips WHERE status <> 'O'")
def s02_union_all(strips):
    """Rows of both branches, repeats kept."""
    return strips.where("status = 'F'").select("strip", "status").unionByName(strips.where("status <> 'O'").select("strip", "status"))
