"""Storage codecs, trends, prioritised mosaics and neighbourhood products."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.operators import grid as G
from gridloom.plans.registry import query
from gridloom.plans.stacks import MASKED, masked

U16 = "CASE WHEN {v} IS NULL THEN 65535 ELSE CAST(trunc(greatest(0.0::DOUBLE, least(65534.0::DOUBLE, CAST(CAST({v} AS FLOAT) * CAST(65534/{m}::DOUBLE AS FLOAT) AS DOUBLE)))) AS INT) END"


@query("obs", "SELECT ok, ln, raw, CASE WHEN raw <> 65535 THEN round(raw*1500/65534::DOUBLE, 9) END AS back FROM (SELECT ok, ln, " + U16.format(v="z", m=1500) + " AS raw FROM j)", MASKED, "j AS (SELECT ok, ln, CASE WHEN tag THEN z END AS z FROM obs)")
def q01_dem_codec(obs):
    raw = obs.select("ok", "ln", C.encode_unsigned(F.when(F.col("tag"), F.col("z")), 1500).alias("raw"))
    return raw.withColumn("back", F.round(C.decode_unsigned("raw", 1500), 9))


@query("dems", "SELECT dem_id, raw, round(raw*50/32766::DOUBLE, 9) AS back FROM (SELECT dem_id, CAST(trunc(greatest(-32767.0::DOUBLE, least(32766.0::DOUBLE, pc*8*32766/50))) AS INT) AS raw FROM dems)")
def q04_slope_codec(dems):
    raw = dems.select("dem_id", C.encode_signed(F.col("pc") * 8, 50).alias("raw"))
    return raw.withColumn("back", F.round(C.decode_signed("raw", 50), 9))


@query("ref", "SELECT r, c, CAST(least(65534.0, round_even(sqrt((slope*900.0::DOUBLE)*(slope*900.0::DOUBLE) + (ref_z*30)*(ref_z*30)), 0)) AS INT) AS h FROM ref")
def q08_hypot_raw(ref):
    return ref.select("r", "c", C.hypot_raw(F.col("slope") * 900, F.col("ref_z") * 30).alias("h"))


YEARS = "y AS (SELECT r, c, yr, median(z) AS z FROM masked WHERE z IS NOT NULL GROUP BY r, c, yr)"
TREND = "f AS (SELECT r, c, count(*) AS n, regr_sxx(z, yr-1995) AS sxx, regr_sxy(z, yr-1995) AS sxy, regr_syy(z, yr-1995) AS syy, avg(z) AS mz, avg(yr-1995) AS mt FROM y GROUP BY r, c), t AS (SELECT *, CASE WHEN n >= 2 AND sxx > 0 THEN CASE WHEN abs(syy) <= 1e-12 THEN 0 ELSE sxy/sxx END END AS slope FROM f), e AS (SELECT r, c, z - slope*(yr-1995) - (mz - slope*mt) AS e FROM y JOIN t USING (r, c)), d AS (SELECT r, c, 1.4826*median(abs(e-m)) AS nmad FROM (SELECT *, median(e) OVER (PARTITION BY r, c) AS m FROM e) GROUP BY r, c)"


def yearly(obs):
    y = masked(obs).where("z is not null").groupBy("r", "c", "yr").agg(F.median("z").alias("z"))
    return y.select("r", "c", (F.col("yr") - 1995).cast("double").alias("t"), "z")


@query("obs", "SELECT r, c, n, round(slope, 7) AS slope, round(mz - slope*mt, 7) AS intercept, round(CASE WHEN slope IS NULL THEN NULL WHEN abs(syy) <= 1e-12 THEN 0 ELSE sxy/sqrt(sxx*syy) END, 7) AS r_value, round(nmad, 4) AS nmad FROM t JOIN d USING (r, c)", MASKED, YEARS, TREND)
def a17_linear_trend(obs):
    t = G.linear_trend(yearly(obs), ["r", "c"], "t", "z")
    return t.select("r", "c", "n", F.round("slope", 7).alias("slope"), F.round("intercept", 7).alias("intercept"), F.round("corr", 7).alias("r_value"), F.round("nmad", 4).alias("nmad"))


#: Fixed values of the prioritised mosaic: source, quality code, NMAD below which it counts, observations it needs.
SOURCES = [("vertcoreg", 4, 10, 1), ("p75", 1, 10, 1), ("p95", 2, 30, 1), ("uncorr", 3, 30, 3)]
SOURCED = "x AS (SELECT r, c, yr, CASE dem_id % 4 WHEN 0 THEN 'vertcoreg' WHEN 1 THEN 'p75' WHEN 2 THEN 'p95' ELSE 'uncorr' END AS src, z/20 AS z FROM obs)"
STACKED = "m AS (SELECT r, c, yr, src, any_value(m) AS z, 1.4826*median(abs(z-m)) AS nmad, count(*) AS n FROM (SELECT *, median(z) OVER (PARTITION BY r, c, yr, src) AS m FROM x) GROUP BY r, c, yr, src)"
GATED = """g AS (SELECT r, c, yr, CASE src WHEN 'vertcoreg' THEN 4 WHEN 'p75' THEN 1 WHEN 'p95' THEN 2 ELSE 3 END AS q, CASE src WHEN 'vertcoreg' THEN 1 WHEN 'p75' THEN 2 WHEN 'p95' THEN 3 ELSE 4 END AS prio,
z + CASE WHEN src = 'uncorr' THEN (yr-1995)*0.5::DOUBLE ELSE 0 END AS z FROM (SELECT *, bool_or(src = 'vertcoreg') OVER (PARTITION BY r // 8, c // 8, yr) AS covered FROM m)
WHERE nmad < CASE WHEN src IN ('vertcoreg', 'p75') THEN 10 ELSE 30 END AND (src <> 'uncorr' OR n >= 3) AND NOT (covered AND src IN ('p75', 'p95')))"""
MOSAIC = "SELECT r, c, yr, round(arg_min(g.z, prio), 9) AS z, CAST(coalesce(arg_min(q, prio), 0) AS INT) AS quality FROM (SELECT DISTINCT r, c, yr FROM m) LEFT JOIN g USING (r, c, yr) GROUP BY r, c, yr"


def prioritised(obs, tile: int = 8):
    """Of four sources by cell and year the first whose NMAD and count pass; a tile that has the first source in a year takes
    neither of the next two; the last has the year's bias added. Quality 0 and no value where none passes."""
    name = F.element_at(F.array(*(F.lit(s[0]) for s in SOURCES)), (F.col("dem_id") % 4 + 1).cast("int"))
    m = G.robust_stack(obs.select("r", "c", "yr", name.alias("src"), (F.col("z") / 20).alias("z")), ["r", "c", "yr", "src"], "z")
    cell = m.groupBy("r", "c", "yr").agg(*(F.max(F.when(F.col("src") == s, F.struct("median", "nmad", "n"))).alias(s) for s, *_ in SOURCES))
    here = [F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc")]
    covered = cell.where("vertcoreg is not null").select(*here, "yr", F.lit(True).alias("covered")).distinct()
    cell = cell.select("*", *here).join(covered, ["tr", "tc", "yr"], "left")
    options = []
    for s, code, nmad, n in SOURCES:
        ok = (F.col(s)["nmad"] < nmad) & (F.col(s)["n"] >= n)
        if s in ("p75", "p95"):
            ok = ok & F.col("covered").isNull()
        value = F.col(s)["median"] + ((F.col("yr") - 1995) * 0.5 if s == "uncorr" else 0.0)
        options.append((ok, value, code))
    z, q = G.priority_coalesce(options)
    return cell.select("r", "c", "yr", z.alias("z"), q.alias("quality"))


@query("obs", MOSAIC, SOURCED, STACKED, GATED)
def r04_priority_mosaic(obs):
    return prioritised(obs).select("r", "c", "yr", F.round("z", 9).alias("z"), "quality")


MOSAIC_TREND = """SELECT r, c, period, count(*) AS n, round(regr_slope(z, yr), 7) AS slope, round(regr_intercept(z, yr - 1995), 7) AS intercept FROM
(SELECT *, unnest(CASE WHEN yr <= 1995 THEN ['early', 'all'] ELSE ['late', 'all'] END) AS period FROM w WHERE z IS NOT NULL) GROUP BY r, c, period HAVING count(*) >= 2"""


@query("obs", MOSAIC_TREND, SOURCED, STACKED, GATED, f"w AS ({MOSAIC})")
def r03_mosaic_trends(obs):
    """Yearly prioritised mosaics, then trends over the early years, the late ones and all, each year listed in two periods."""
    w = prioritised(obs).select("r", "c", "yr", F.round("z", 9).alias("z")).where("z is not null")
    period = F.when(F.col("yr") <= 1995, F.array(F.lit("early"), F.lit("all"))).otherwise(F.array(F.lit("late"), F.lit("all")))
    t = G.linear_trend(w.withColumn("period", F.explode(period)).withColumn("t", F.col("yr") - 1995), ["r", "c", "period"], "t", "z").where("n >= 2")
    return t.select("r", "c", "period", "n", F.round("slope", 7).alias("slope"), F.round("intercept", 7).alias("intercept"))


REACH = 4
STACKS = "m AS (SELECT r, c, yr, src, median(z) AS z, 1.4826::DOUBLE*median(abs(z-mid)) AS nmad, count(*) AS n, median(dayofyear(d)) AS doy FROM (SELECT x.*, median(z) OVER (PARTITION BY r, c, yr, src) AS mid FROM x) GROUP BY r, c, yr, src)"
DATED = SOURCED.replace("SELECT r, c, yr, CASE", "SELECT r, c, yr, d, CASE")
GATES = GATED.replace("ELSE 0 END AS z FROM (SELECT", "ELSE 0 END AS z, nmad, n, doy FROM (SELECT")
TILE_CTES = (
    DATED, STACKS, GATES,
    "a AS (SELECT r, c, yr, arg_min(z, prio) AS z, arg_min(nmad, prio) AS nmad, arg_min(n, prio) AS n, arg_min(doy, prio) AS doy, arg_min(q, prio) AS q FROM g GROUP BY r, c, yr)",
    "b AS (SELECT r, c, yr, median(z) AS z, 1.4826::DOUBLE*median(abs(z-mid)) AS nmad, count(*) AS n, median(dayofyear(d)) AS doy FROM (SELECT x.*, median(z) OVER (PARTITION BY r, c, yr) AS mid FROM x) GROUP BY r, c, yr)",
    f"v AS (SELECT o.r, o.c, greatest(0.0, 1 - sqrt(min((o.r-i.r)*(o.r-i.r) + (o.c-i.c)*(o.c-i.c))) / {REACH}) AS w FROM ref o JOIN ref i ON i.slope = 50 AND abs(o.r-i.r) < {REACH} AND abs(o.c-i.c) < {REACH} GROUP BY o.r, o.c)",
    """u AS (SELECT b.r, b.c, b.yr, a.z IS NOT NULL AS ha, coalesce(w, 0) > 0 AS hb, coalesce(w, 0) AS w, zone LIKE 'Brand#5%' AND b.yr >= 1997 AS ocean, coalesce(q, 0) AS q, a.z AS za, a.nmad AS na, a.n AS ca, a.doy AS da, b.z AS zb, b.nmad AS nb, b.n AS cb, b.doy AS db
  FROM b JOIN ref USING (r, c) LEFT JOIN a ON a.r = b.r AND a.c = b.c AND a.yr = b.yr LEFT JOIN v ON v.r = b.r AND v.c = b.c)""",
    """tile AS (SELECT r, c, yr, ocean, CASE WHEN ocean THEN 0 ELSE q END AS quality, CASE WHEN NOT ocean THEN CASE WHEN ha AND hb THEN w*zb + (1-w)*za WHEN ha THEN za WHEN hb THEN zb END END AS z,
  CASE WHEN NOT ocean THEN CASE WHEN ha AND hb THEN w*nb + (1-w)*na WHEN ha THEN na WHEN hb THEN nb END END AS nmad, CASE WHEN ocean THEN 0 WHEN ha AND hb THEN greatest(ca, cb) WHEN ha THEN ca WHEN hb THEN cb ELSE 0 END AS n,
  CASE WHEN ocean THEN 0 WHEN ha AND hb THEN CASE WHEN w >= 0.5 THEN db ELSE da END WHEN ha THEN da WHEN hb THEN db ELSE 0 END AS doy FROM u)""",
)


#: Cells of a block along an axis (whole tiles); a task holds a year of one.
BLOCK = 128


def stacks_by_source(obs, tile: int = 8):
    """r, c, yr, covered (whether the first source is in the cell's tile in that year), and by source, and of ``all``, a struct of median,
    nmad, n and doy (null without observations): all stacks of a cell and year from one shuffle of the observations by blocks."""
    at = lambda v: F.floor(F.col(v) / BLOCK).cast("int")
    rows = obs.dropna(subset=["r", "c", "yr"]).select(at("r").alias("br"), at("c").alias("bc"), "yr", "r", "c", F.coalesce((F.col("dem_id") % 4).cast("int"), F.lit(-1)).alias("src"), (F.col("z") / 20).alias("z"), F.dayofyear("d").cast("double").alias("doy"))
    names, parts = [*(s for s, *_ in SOURCES), "all"], ("median", "nmad", "n", "doy")

    def middles(v: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Median and count of the values that are there, by group."""
        there = ~np.isnan(v)
        v, group = v[there], group[there]
        v, n = v[np.lexsort((v, group))], np.bincount(group, minlength=size)
        first, out, k = np.cumsum(n) - n, np.full(size, np.nan), n > 0
        out[k] = (v[first[k] + (n[k] - 1) // 2] + v[first[k] + n[k] // 2]) / 2
        return out, n

    def stacks(df: pd.DataFrame) -> pd.DataFrame:
        rc, cell = np.unique(np.column_stack([df.r, df.c]), axis=0, return_inverse=True)
        cell, src, z, doy = cell.ravel(), df.src.to_numpy(), df.z.to_numpy(float), df.doy.to_numpy(float)
        out = pd.DataFrame({"yr": df.yr.iloc[0], "r": rc[:, 0], "c": rc[:, 1]})
        tiles = rc // tile
        first = np.isin(np.arange(len(rc)), cell[src == 0])
        out["covered"] = pd.MultiIndex.from_arrays(tiles.T).isin(list(map(tuple, tiles[first])))
        known = src >= 0
        for group, size, columns, kept in (((cell * len(SOURCES) + src)[known], len(rc) * len(SOURCES), names[:-1], known), (cell, len(rc), names[-1:], slice(None))):
            mid, n = middles(z[kept], group, size)
            nmad = C.NMAD_SCALE * middles(np.abs(z[kept] - mid[group]), group, size)[0]
            n = np.where(np.bincount(group, minlength=size) > 0, n, np.nan)
            for part, v in zip(parts, (mid, nmad, n, middles(doy[kept], group, size)[0]), strict=True):
                for i, name in enumerate(columns):
                    out[f"{name}_{part}"] = v[i :: len(columns)]
        return out

    tasks = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "yr int, r int, c int, covered boolean, " + ", ".join(f"{n}_{p} double" for n in names for p in parts)
    got = rows.repartition(tasks, "br", "bc", "yr").groupBy("br", "bc", "yr").applyInPandas(stacks, schema)
    held = lambda n: F.when(F.col(f"{n}_n").isNotNull(), F.struct(*(F.col(f"{n}_{p}").cast("long" if p == "n" else "double").alias(p) for p in parts))).alias(n)
    return got.select("r", "c", "yr", "covered", *map(held, names))


def mosaic_tile(obs, ref):
    """R3's yearly bands in one chain: the prioritised sources, blended at the seam of a region with another stack (value and spread by
    weight, the greater count, the day of the side that weighs more), without what is ocean in the year."""
    cell = stacks_by_source(obs)
    a = F.lit(None)
    for s, code, nmad, n in reversed(SOURCES):
        ok = (F.col(s)["nmad"] < nmad) & (F.col(s)["n"] >= n) & (~F.col("covered") if s in ("p75", "p95") else F.lit(True))
        value = F.col(s)["median"] + ((F.col("yr") - 1995) * 0.5 if s == "uncorr" else 0.0)
        a = F.when(ok, F.struct(value.alias("z"), F.col(s)["nmad"].alias("nmad"), F.col(s)["n"].alias("n"), F.col(s)["doy"].alias("doy"), F.lit(code).alias("q"))).otherwise(a)
    b = F.struct(F.col("all.median").alias("z"), F.col("all.nmad").alias("nmad"), F.col("all.n").alias("n"), F.col("all.doy").alias("doy"))
    both = cell.select("r", "c", "yr", a.alias("a"), b.alias("b"))
    around = [(i, j) for i in range(1 - REACH, REACH) for j in range(1 - REACH, REACH)]
    seen = G.neighbours(ref.where("slope = 50").select("r", "c"), around)
    w = seen.groupBy("r", "c").agg(F.greatest(F.lit(0.0), 1 - F.sqrt(F.min(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc"))) / REACH).alias("w"))
    u = both.join(ref.select("r", "c", (F.col("zone").startswith("Brand#5")).alias("gone")).join(w, ["r", "c"], "left"), ["r", "c"])
    u = u.withColumn("w", F.coalesce("w", F.lit(0.0))).withColumn("ocean", F.col("gone") & (F.col("yr") >= 1997))
    ha, hb = F.col("a").isNotNull(), F.col("w") > 0
    pick = lambda both, x: F.when(ha & hb, both).when(ha, F.col("a")[x]).when(hb, F.col("b")[x])
    mixed = lambda x: F.when(~F.col("ocean"), pick(F.col("w") * F.col("b")[x] + (1 - F.col("w")) * F.col("a")[x], x))
    known = lambda c: F.when(F.col("ocean"), 0).otherwise(F.coalesce(c, F.lit(0)))
    dominant = F.when(F.col("w") >= 0.5, F.col("b.doy")).otherwise(F.col("a.doy"))
    return u.select("r", "c", "yr", "ocean", known(F.col("a.q")).cast("int").alias("quality"), mixed("z").alias("z"), mixed("nmad").alias("nmad"), known(pick(F.greatest(F.col("a.n"), F.col("b.n")), "n")).alias("n"), known(pick(dominant, "doy")).alias("doy"))


@query("obs ref", "SELECT r, c, yr, ocean, CAST(quality AS INT) AS quality, round(z, 9) AS z, round(nmad, 4) AS nmad, n, doy::DOUBLE AS doy FROM tile", *TILE_CTES)
def r03_mosaic_tile(obs, ref):
    """The bands of every year."""
    return mosaic_tile(obs, ref).select("r", "c", "yr", "ocean", "quality", F.round("z", 9).alias("z"), F.round("nmad", 4).alias("nmad"), "n", F.col("doy").cast("double").alias("doy"))


TILE_TRENDS = """, k AS (SELECT r, c, quality, count(*) AS n FROM tile WHERE quality > 0 GROUP BY r, c, quality), q AS (SELECT r, c, CAST(arg_max(quality, (n, -quality)) AS INT) AS quality_mode FROM k GROUP BY r, c),
p AS (SELECT *, unnest(CASE WHEN yr <= 1995 THEN ['early', 'all'] ELSE ['late', 'all'] END) AS period FROM tile WHERE z IS NOT NULL)
SELECT r, c, period, count(*) AS n, round(regr_slope(z, yr - 1995 + (doy - 1) / 365.25), 7) AS slope, round(regr_intercept(z, yr - 1995 + (doy - 1) / 365.25), 6) AS intercept, max(quality_mode) AS quality_mode FROM p LEFT JOIN q USING (r, c) GROUP BY r, c, period HAVING count(*) >= 2"""


@query("obs ref", TILE_TRENDS, *TILE_CTES)
def r03_tile_trends(obs, ref):
    """Trends of each period over the blended bands, at the years with their days, and the commonest quality code of a cell."""
    from gridloom.sources.files import stored

    tile = stored(mosaic_tile(obs, ref).select("r", "c", "yr", "quality", "z", "doy"), "tile")
    k = tile.where("quality > 0").groupBy("r", "c", "quality").agg(F.count("*").alias("n"))
    mode = k.groupBy("r", "c").agg(F.max_by("quality", F.struct("n", -F.col("quality"))).alias("quality_mode"))
    period = F.when(F.col("yr") <= 1995, F.array(F.lit("early"), F.lit("all"))).otherwise(F.array(F.lit("late"), F.lit("all")))
    p = tile.where("z is not null").withColumn("period", F.explode(period)).withColumn("t", F.col("yr") - 1995 + (F.col("doy") - 1) / 365.25)
    t = p.groupBy("r", "c", "period").agg(F.count("*").alias("n"), F.round(F.regr_slope("z", "t"), 7).alias("slope"), F.round(F.regr_intercept("z", "t"), 6).alias("intercept")).where("n >= 2")
    return t.join(mode, ["r", "c"], "left").select("r", "c", "period", "n", "slope", "intercept", "quality_mode")


@query("obs", "SELECT r, c, CAST(max(yr) AS INT) AS yr, round(arg_max(z, yr), 9) AS z FROM (SELECT r, c, yr, median(z) AS z FROM obs WHERE tag AND yr <= 2000 GROUP BY r, c, yr) GROUP BY r, c")
def r25_year_cascade(obs):
    """The latest year at or before the start that has a value."""
    y = obs.where("tag and yr <= 2000").groupBy("r", "c", "yr").agg(F.median("z").alias("z"))
    return y.groupBy("r", "c").agg(F.max("yr").alias("yr"), F.round(F.max_by("z", "yr"), 9).alias("z"))


DIAMOND = [(i, j) for i in range(-3, 4) for j in range(-3, 4) if abs(i) + abs(j) <= 3]


@query("ref", "SELECT DISTINCT a.r, a.c FROM ref a JOIN ref b ON abs(a.r-b.r) + abs(a.c-b.c) <= 3 WHERE b.slope = 50")
def r13_dilate_mask(ref):
    """Dilation by a diamond of radius 3; shifted cells outside the grid go with the join."""
    grown = G.neighbours(ref.where("slope = 50").select("r", "c"), DIAMOND).select("r", "c").distinct()
    return ref.select("r", "c").join(grown, ["r", "c"], "left_semi")


@query("ref", "SELECT m.r, m.c, round(sqrt(((e.ref_z-w.ref_z)/2)*((e.ref_z-w.ref_z)/2) + ((s.ref_z-n.ref_z)/2)*((s.ref_z-n.ref_z)/2)), 8) AS slope, round(e.ref_z+w.ref_z+n.ref_z+s.ref_z-4*m.ref_z, 8) AS curvature FROM ref m LEFT JOIN ref e ON e.r=m.r AND e.c=m.c+1 LEFT JOIN ref w ON w.r=m.r AND w.c=m.c-1 LEFT JOIN ref n ON n.r=m.r-1 AND n.c=m.c LEFT JOIN ref s ON s.r=m.r+1 AND s.c=m.c")
def r17_slope_curvature(ref):
    """Gradient and Laplacian from a five-point stencil."""
    x = G.stencil(ref, "ref_z", {"m": (0, 0), "e": (0, 1), "w": (0, -1), "n": (-1, 0), "s": (1, 0)})
    dx, dy = (F.col("e") - F.col("w")) / 2, (F.col("s") - F.col("n")) / 2
    return x.select("r", "c", F.round(F.sqrt(dx * dx + dy * dy), 8).alias("slope"), F.round(F.col("e") + F.col("w") + F.col("n") + F.col("s") - 4 * F.col("m"), 8).alias("curvature"))
