"""Exact quantiles of large groups, without a task that holds a group's values.

Values are counted in buckets of equal width between a group's least and greatest finite one (infinities and NaN have buckets of
their own); the buckets that hold the wanted ranks are found from the counts. One with more than ``most`` values that aren't all
equal is cut again between its own least and greatest, so outliers take another round, not a larger task. Only what is left is
ordered, each value with its count, so ties weigh nothing. Groups should be few: a group has ``buckets`` counts at most. The frame
is read three times (ends, counts, values) and once for each further round, so it should be a scan or stored; what is small in
between is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.functions.columns import NMAD_SCALE
from gridloom.operators import grid as G
from gridloom.sources.files import stored

#: Values of a bucket that are ordered by one task at most, unless they are all equal.
MOST = 1 << 20


def _bucket(n: int) -> Column:
    """-1 to n + 1: minus infinity, n buckets of equal width from _lo to _hi, infinity, NaN."""
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    inner = F.when(hi > lo, F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(share * n).cast("int")))).otherwise(0)
    return F.when(F.isnan(v), n + 1).when(v == float("inf"), n).when(v == float("-inf"), -1).otherwise(inner)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], buckets: int = 4096, most: int = MOST) -> DataFrame:
    """keys, ``n`` (values that are there) and a column per name of ``probs``: the quantile between the two nearest ranks."""
    key = F.xxhash64(F.lit(0), *keys, *(F.col(k).isNull() for k in keys))  # 64 bits tell few groups apart
    rows = df.where(F.col(value).isNotNull()).select(*keys, key.alias("_k"), F.col(value).cast("double").alias("_v"))
    finite = F.when(~F.isnan("_v") & (F.abs("_v") < float("inf")), F.col("_v"))
    ends = rows.groupBy("_k").agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"), F.count("*").alias("n"), *(F.first(k).alias(k) for k in keys))
    ends = stored(ends, "ends")
    place = lambda p: (F.col("n") - 1) * F.lit(p)
    each = [F.struct(F.lit(name).alias("name"), rank(place(p)).cast("long").alias("rank")) for name, p in probs.items() for rank in (F.floor, F.ceil)]
    ranks = ends.select("_k", F.explode(F.array_distinct(F.array(*each))).alias("w")).select("_k", "w.*")
    # ranges: (_k, _r, _lo, _hi, _before), disjoint by key; at first a key's all
    ranges, within = ends.select("_k", F.lit(0).cast("long").alias("_r"), "_lo", "_hi", F.lit(0).cast("long").alias("_before")), F.lit(True)
    while True:
        found = rows.select("_k", "_v").join(G.checked_broadcast(ranges), "_k").where(within).withColumn("_b", _bucket(buckets))
        counts = found.groupBy("_k", "_r", "_before", "_b").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        ahead = F.coalesce(F.sum("_c").over(W.partitionBy("_k", "_r").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        now = counts.withColumn("_before", F.col("_before") + ahead).join(ranks, "_k").where("rank >= _before and rank < _before + _c")
        number = F.dense_rank().over(W.partitionBy("_k").orderBy("_before")).cast("long")  # of the few ranges with a wanted rank
        now = now.withColumn("_r", number).select("_k", "_r", "_lo", "_hi", "_before", "_c", "name", "rank")
        held = stored(now, "ranks")
        ranges = held.select("_k", "_r", "_lo", "_hi", "_before").distinct()
        within = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
        if not held.where((F.col("_c") > most) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
            break
    equal = held.where("_lo = _hi").select("_k", "name", F.col("_lo").alias("_v"))
    apart = held.where("not (_lo = _hi)")
    named = G.checked_broadcast(apart.select("_k", "_r", "_lo", "_hi", "_before").distinct())
    values = rows.select("_k", "_v").join(named, "_k").where(within).groupBy("_k", "_r", "_before", "_v").agg(F.count("*").alias("_c"))
    last = F.col("_before") + F.sum("_c").over(W.partitionBy("_k", "_r").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    values = values.withColumn("_last", last).drop("_before")
    ordered = apart.select("_k", "_r", "name", "rank").join(values, ["_k", "_r"]).where("rank < _last and rank >= _last - _c").select("_k", "name", "_v")
    wide = ordered.unionByName(equal).groupBy("_k", "name").agg(F.min("_v").alias("a"), F.max("_v").alias("b"))
    wide = wide.groupBy("_k").agg(*(F.max(F.when(F.col("name") == x, F.struct("a", "b"))).alias(x) for x in probs))
    part = lambda p: place(p) - F.floor(place(p))
    between = lambda x, p: F.when(F.col(x)["a"] == F.col(x)["b"], F.col(x)["a"]).otherwise(F.col(x)["a"] + (F.col(x)["b"] - F.col(x)["a"]) * part(p))
    return ends.join(wide, "_k").select(*keys, "n", *(between(x, p).alias(x) for x, p in probs.items()))


def exact_nmad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, median and NMAD of large groups."""
    mid = stored(exact_quantiles(df, keys, value, {"median": 0.5}), "medians")
    names = [f"_k{i}" for i in range(len(keys))]
    side = G.checked_broadcast(mid.select(*(F.col(k).alias(a) for k, a in zip(keys, names, strict=True)), "median"))
    on = [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, names, strict=True)] or [F.lit(True)]  # without keys one row
    off = df.join(side, on).withColumn("_off", F.abs(F.col(value) - F.col("median"))).select(*keys, "_off")
    spread = exact_quantiles(off, keys, "_off", {"_mad": 0.5}).select(*(F.col(k).alias(a) for k, a in zip(keys, names, strict=True)), (F.col("_mad") * NMAD_SCALE).alias("nmad"))
    return mid.join(spread, on).select(*keys, "n", "median", "nmad")
