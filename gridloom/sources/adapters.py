"""Views of the star-schema tables as cells, footprints, points and series, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.columns import day_code

WIDTH, TILE = 40, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    d = F.col("l_shipdate").cast("date")
    return t.select(
        F.floor(F.col("l_partkey") / float(WIDTH)).cast("int").alias("r"), (F.col("l_partkey") % WIDTH).cast("int").alias("c"), F.col("l_suppkey").alias("dem_id"),
        d.alias("d"), F.year(d).alias("yr"), day_code(d).alias("day_code"), (F.col("l_extendedprice") / 100).alias("z"), (F.col("l_discount") * 2550).alias("proba"),
        (F.col("l_returnflag") != "R").alias("tag"), F.col("l_tax").alias("a"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"),
    )


def ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / float(WIDTH)).cast("int").alias("r"), (F.col("p_partkey") % WIDTH).cast("int").alias("c"), F.col("p_retailprice").alias("ref_z"),
        F.col("p_size").alias("slope"), F.col("p_brand").alias("zone"), (F.col("p_size") > 25).alias("stable"),
    )


def dems(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("region"))
    s = table(spark, sf_dir, "supplier").join(F.broadcast(n), "s_nationkey")  # nations: 25 rows at every scale
    return s.select(F.col("s_suppkey").alias("dem_id"), "region", (F.col("s_acctbal") / 1000000).alias("pa"), (F.col("s_acctbal") / -2000000).alias("pb"), (F.col("s_acctbal") / 1000).alias("pc"), (F.col("s_suppkey") % 100).alias("n_cmp"))


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = (F.col("o_custkey") % 40).cast("double"), (F.col("o_orderkey") % 53).cast("double")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("strip"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("o_orderkey") % 7 + 1).alias("x1"), (y0 + F.col("o_custkey") % 5 + 1).alias("y1"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderstatus").alias("status"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ref(spark, sf_dir).select(F.floor(F.col("r") / TILE).cast("int").alias("tr"), F.floor(F.col("c") / TILE).cast("int").alias("tc")).distinct()
    return t.select("tr", "tc", (F.col("tc") * 8.0).alias("tx0"), (F.col("tr") * 8.0).alias("ty0"), (F.col("tc") * 8.0 + 8).alias("tx1"), (F.col("tr") * 8.0 + 8).alias("ty1"))


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("pid"), (k % WIDTH + 0.5).alias("x"), (F.floor(k / float(WIDTH)) + 0.5).alias("y"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("seg"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("track"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("h"), "user_id", "props")


#: The same views in DuckDB's SQL.
SQL = {
    "obs": "obs AS (SELECT CAST(floor(l_partkey/40.0) AS INT) AS r, CAST(l_partkey % 40 AS INT) AS c, l_suppkey AS dem_id, CAST(l_shipdate AS DATE) AS d, CAST(year(l_shipdate) AS INT) AS yr, CAST(month(l_shipdate)*30+day(l_shipdate) AS INT) AS day_code, l_extendedprice/100 AS z, l_discount*2550 AS proba, l_returnflag <> 'R' AS tag, l_tax AS a, l_orderkey AS ok, l_linenumber AS ln FROM lineitem)",
    "ref": "ref AS (SELECT CAST(floor(p_partkey/40.0) AS INT) AS r, CAST(p_partkey % 40 AS INT) AS c, p_retailprice AS ref_z, p_size AS slope, p_brand AS zone, p_size > 25 AS stable FROM part)",
    "dems": "dems AS (SELECT s_suppkey AS dem_id, n_name AS region, s_acctbal/1000000 AS pa, s_acctbal/-2000000 AS pb, s_acctbal/1000 AS pc, s_suppkey % 100 AS n_cmp FROM supplier JOIN nation ON n_nationkey = s_nationkey)",
    "strips": "strips AS (SELECT o_orderkey AS strip, CAST(o_custkey % 40 AS DOUBLE) AS x0, CAST(o_orderkey % 53 AS DOUBLE) AS y0, CAST(o_custkey % 40 + o_orderkey % 7 + 1 AS DOUBLE) AS x1, CAST(o_orderkey % 53 + o_custkey % 5 + 1 AS DOUBLE) AS y1, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS status FROM orders)",
    "tiles": "tiles AS (SELECT DISTINCT CAST(floor(floor(p_partkey/40.0)/8) AS INT) AS tr, CAST(floor((p_partkey % 40)/8.0) AS INT) AS tc, floor((p_partkey % 40)/8.0)*8.0::DOUBLE AS tx0, floor(floor(p_partkey/40.0)/8)*8.0::DOUBLE AS ty0, floor((p_partkey % 40)/8.0)*8.0::DOUBLE+8 AS tx1, floor(floor(p_partkey/40.0)/8)*8.0::DOUBLE+8 AS ty1 FROM part)",
    "pts": "pts AS (SELECT c_custkey AS pid, CAST(c_custkey % 40 AS DOUBLE) + 0.5::DOUBLE AS x, floor(c_custkey/40.0::DOUBLE) + 0.5::DOUBLE AS y, c_acctbal AS v, c_mktsegment AS seg FROM customer)",
    "series": "series AS (SELECT event_id, event_type AS track, ts, value AS h, user_id, props FROM events)",
}


def sql_with(names: str, *more: str) -> str:
    """WITH clause of the named views and further CTEs."""
    return "WITH " + ", ".join([*(SQL[n] for n in names.split()), *more]) + " "
