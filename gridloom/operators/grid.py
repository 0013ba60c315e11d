"""Operators over cells: robust stacks, trends, mosaics, neighbourhoods, spatial and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.functions.columns import NMAD_SCALE

#: Rows up to which a side that stems from a dimension table is broadcast; counted, never assumed.
BROADCAST_ROWS = 100_000


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the frame has at most ``rows`` rows (counted no further); otherwise joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def robust_stack(df: DataFrame, keys: list[str], value: str, *extra: Column) -> DataFrame:
    """Exact median, NMAD and count of ``value`` by ``keys`` from one shuffle.

    Values of a group are gathered once (a cell-year has few) and both statistics come from the sorted array.
    """
    some = F.col(value).isNotNull()
    got = df.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_v"), F.count(F.when(some, 1)).alias("n"), *extra)
    mid = lambda a: F.when(F.size(a) > 0, (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, (F.floor(F.size(a) / 2) + 1).cast("int"))) / 2)
    # element_at by 1 where the array is empty is never evaluated: the guard above is lazy
    got = got.withColumn("median", mid(F.col("_v")))
    off = F.array_sort(F.transform("_v", lambda v: F.abs(v - F.col("median"))))
    return got.withColumn("_d", off).withColumn("nmad", NMAD_SCALE * mid(F.col("_d"))).drop("_v", "_d")


def by_cell(df: DataFrame) -> DataFrame:
    """``df`` dealt by cell (r, c). Aggregations by cell and year, and by cell after them, then need no shuffle of their own, and few
    values a group aren't aggregated before the shuffle, where it hardly makes them fewer."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "r", "c")


def with_group_median(df: DataFrame, keys: list[str], value, name: str) -> DataFrame:
    return df.withColumn(name, F.median(value).over(W.partitionBy(*keys)))


def linear_trend(df: DataFrame, keys: list[str], t: str, y: str) -> DataFrame:
    """n, slope, intercept, corr, sxx and the NMAD of residuals; null below two observations, slope and corr 0 if y is flat."""
    df = df.where(F.col(y).isNotNull() & F.col(t).isNotNull())
    fit = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(t).alias("_mt"), F.avg(y).alias("_my"), F.regr_sxx(y, t).alias("sxx"), F.regr_sxy(y, t).alias("_sxy"), F.regr_syy(y, t).alias("_syy")
    )
    enough, flat = (F.col("n") >= 2) & (F.col("sxx") > 0), F.abs("_syy") <= 1e-12
    fit = fit.withColumn("slope", F.when(enough, F.when(flat, 0.0).otherwise(F.try_divide("_sxy", "sxx"))))
    fit = fit.withColumn("intercept", F.when(enough, F.col("_my") - F.col("slope") * F.col("_mt")))
    fit = fit.withColumn("corr", F.when(enough, F.when(flat, 0.0).otherwise(F.try_divide(F.col("_sxy"), F.sqrt(F.col("sxx") * F.col("_syy"))))))
    both = df.select(*keys, t, y).join(fit.select(*keys, "slope", "intercept"), keys)
    res = both.withColumn("_e", F.col(y) - F.col("slope") * F.col(t) - F.col("intercept"))
    res = robust_stack(res, keys, "_e").select(*keys, "nmad")
    return fit.drop("_mt", "_my", "_sxy", "_syy").join(res, keys)


def neighbours(df: DataFrame, offsets: list[tuple[int, int]], r: str = "r", c: str = "c") -> DataFrame:
    """Each cell's columns as seen from the cells at ``offsets`` around it: (r, c) are shifted, (dr, dc) tell the offset.

    An equi-join on the shifted place replaces a spatial join; cells explode by the number of offsets.
    """
    each = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in offsets))
    out = df.withColumn("_o", F.explode(each)).select("*", "_o.dr", "_o.dc").drop("_o")
    return out.withColumn(r, F.col(r) - F.col("dr")).withColumn(c, F.col(c) - F.col("dc"))


SQUARE = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def stencil(df: DataFrame, value: str, names: dict[str, tuple[int, int]], r: str = "r", c: str = "c") -> DataFrame:
    """A row per cell with the neighbours' values as columns (null outside the grid), from one shuffle."""
    seen = neighbours(df.select(r, c, value), sorted({*names.values(), (0, 0)}), r, c)
    aggs = [F.max(F.when((F.col("dr") == dr) & (F.col("dc") == dc), F.col(value))).alias(n) for n, (dr, dc) in names.items()]
    here = F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.lit(True)))
    return seen.groupBy(r, c).agg(*aggs, here.alias("_here")).where("_here").drop("_here")


def range_join_by_tile(boxes: DataFrame, tiles: DataFrame, size: float, exact: Column) -> DataFrame:
    """Rectangles (x0, y0, x1, y1) with the tiles (tr, tc and t-prefixed bounds) that ``exact`` accepts.

    A rectangle is listed under each tile it touches, so the range join is an equi-join; no pair arises twice.
    """
    lo = lambda v: F.floor(F.col(v) / size).cast("int")
    first = lambda v: F.when(F.col(v) % size == 0, lo(v) - 1).otherwise(lo(v))  # noqa: E731  touching counts until ``exact``
    listed = boxes.withColumn("tr", F.explode(F.sequence(first("y0"), lo("y1")))).withColumn("tc", F.explode(F.sequence(first("x0"), lo("x1"))))
    return listed.join(tiles, ["tr", "tc"]).where(exact)


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """For each left row the right row of its keys nearest in time (the earlier of two as near), by sorting only.

    Both sides are stacked and filled by two running aggregates, forward and backward over (keys, t): no pairs are made.
    """
    a = left.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.schema[t].dataType).alias("_rt"), F.lit(None).cast(right.schema[value].dataType).alias("_rv"))
    b = right.select(*keys, F.col(t).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.col(t).alias("_rt"), F.col(value).alias("_rv"))
    both = a.unionByName(b).withColumn("_r", F.when(F.col("_side") == 0, F.struct("_rt", "_rv")))
    order, run = ["_t", "_side", "_rv"], (W.unboundedPreceding, 0)
    last = lambda by: F.last("_r", ignorenulls=True).over(W.partitionBy(*keys).orderBy(*by).rowsBetween(*run))
    got = both.withColumn("_p", last(order)).withColumn("_n", last([F.desc(c) for c in order]))
    near = F.when(F.col("_p").isNull(), F.col("_n")).when(F.col("_n").isNull(), F.col("_p"))
    gap = lambda s: F.abs(F.unix_micros(F.col(s)["_rt"]) - F.unix_micros("_t"))
    near = near.when(gap("_n") < gap("_p"), F.col("_n")).otherwise(F.col("_p"))
    return got.where("_side = 1").withColumn("_m", near).select("_l.*", F.col("_m._rt").alias("near_t"), F.col("_m._rv").alias("near_value"))


def lag_by_parts(df: DataFrame, keys: list[str], part: Column, order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the value of the row before, by keys and order, where ``part`` ascends with the order and splits long groups.

    Rows are ordered within their part only; a part's first row takes the last value of the part before it, from a table of
    one row per part.
    """
    df = df.withColumn("_part", part)
    inner = W.partitionBy(*keys, "_part").orderBy(*order)
    lasts = df.groupBy(*keys, "_part").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    before = lasts.withColumn("_before", F.lag("_last").over(W.partitionBy(*keys).orderBy("_part"))).drop("_last")
    both = df.withColumn("_n", F.row_number().over(inner)).withColumn("_lag", F.lag(value).over(inner)).join(before, [*keys, "_part"])
    return both.withColumn(name, F.when(F.col("_n") == 1, F.col("_before")[value]).otherwise(F.col("_lag"))).drop("_part", "_n", "_lag", "_before")


def lerp_lookup(df: DataFrame, curve: DataFrame, x: str, cx: str, cy: str, out: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``out``: the curve's value at ``x``, linear between its points and along its end segments beyond them. Rows without ``x`` go.

    A curve of at most ``rows`` points is broadcast. A longer one is cut into bins of equal width along ``cx``: its segments are listed
    under each bin they touch and rows join by their bin, so neither side meets all of the other. Points of the curve are ordered
    within a bin only.
    """
    points = curve.where(F.col(cx).isNotNull()).select(F.col(cx).cast("double").alias("_x0"), F.col(cy).alias("_y0"))
    after = ["_x0", "_x1", "_y0", "_y1", "_first", "_last"]
    inside = (F.col("_first") | (F.col(x) >= F.col("_x0"))) & (F.col("_last") | (F.col(x) < F.col("_x1")))
    value = F.col("_y0") + (F.col(x) - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0"))
    if points.limit(rows + 1).count() <= rows:
        w = W.orderBy("_x0")
        seg = points.select("_x0", "_y0", F.lead("_x0").over(w).alias("_x1"), F.lead("_y0").over(w).alias("_y1"), F.lag("_x0").over(w).isNull().alias("_first"), F.lead("_x0", 2).over(w).isNull().alias("_last"))
        return df.join(F.broadcast(seg.where("_x1 is not null")), inside).withColumn(out, value).drop(*after)
    ends = points.agg(F.min("_x0").alias("lo"), F.max("_x0").alias("hi"), F.count("*").alias("n")).first()
    n = max(1, ends.n // max(1, rows // 100))
    width = (ends.hi - ends.lo) / n
    number = lambda c: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((c - ends.lo) / width))).cast("long")
    from_ = lag_by_parts(points.withColumn("_p", F.struct("_x0", "_y0")), [], number(F.col("_x0")), ["_x0"], "_p", "_q").where("_q is not null")
    seg = from_.select(F.col("_q._x0").alias("_x0"), F.col("_q._y0").alias("_y0"), F.col("_x0").alias("_x1"), F.col("_y0").alias("_y1"))
    seg = seg.withColumn("_first", F.col("_x0") == ends.lo).withColumn("_last", F.col("_x1") == ends.hi)
    listed = seg.withColumn("_bin", F.explode(F.sequence(number(F.col("_x0")), number(F.col("_x1")))))
    return df.withColumn("_bin", number(F.col(x))).join(listed, "_bin").where(inside).withColumn(out, value).drop("_bin", *after)


def priority_coalesce(options: list[tuple[Column, Column, int]]) -> tuple[Column, Column]:
    """(value, code) of the first option whose condition holds: (condition, value, code); code 0 where none does."""
    value, code = F.lit(None).cast("double"), F.lit(0)
    for cond, v, q in reversed(options):
        ok = F.coalesce(cond, F.lit(False)) & v.isNotNull()
        value, code = F.when(ok, v).otherwise(value), F.when(ok, F.lit(q)).otherwise(code)
    return value, code
