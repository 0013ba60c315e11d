"""Scans and sinks over files: typed CSV, JSON with nested records, text, feature collections, partitioned and quantised Parquet."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that driver and executors share; on a single machine without that setting, a temporary
    folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder's place in the shared folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` written and read back, so that its lineage ends."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """A typed CSV scan; no rows where there is no such file."""
    try:
        return spark.read.schema(schema).options(**options).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


#: Cells of a folder of cells along an axis. Making a folder and its file takes far longer than a tile's few rows do.
BLOCK = 128


def by_block(df: DataFrame) -> DataFrame:
    """``df`` (r, c and others) with its block (br, bc), dealt so that a block is one task's: written by block it is one folder with one
    file, where otherwise every task would add a file to every folder. A block has a bounded number of cells."""
    at = lambda v: F.floor(F.col(v) / BLOCK).cast("int")
    return df.withColumn("br", at("r")).withColumn("bc", at("c")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "br", "bc")


def write_once(df: DataFrame, path: str, *partitions: str) -> None:
    """Parquet by partition; what is there already stays."""
    df.write.mode("ignore").partitionBy(*partitions).parquet(path)


#: Features of a collection at most.
FEATURES = 5_000


def write_features(df: DataFrame, path: str, group: str) -> None:
    """Feature collections of a ``group`` (a JSON document a line, FEATURES rows at most): rows (x0, y0, x1, y1 and other columns) as
    boxes with properties."""
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0"))
    properties = F.struct(*(c for c in df.columns if c not in ("x0", "y0", "x1", "y1", group)))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    chunk = F.floor(F.monotonically_increasing_id() / FEATURES)  # stretches of a task's rows
    each = df.select(group, chunk.alias("_chunk"), feature.alias("_feature"))
    each.groupBy(group, "_chunk").agg(F.collect_list("_feature").alias("features")).drop("_chunk").write.json(path)


def read_features(spark: SparkSession, path: str, group: str, properties: str) -> DataFrame:
    """Features with their bounds; ``properties`` is the schema of what they carry."""
    schema = f"{group} string, features array<struct<properties: struct<{properties}>, geometry: struct<coordinates: array<array<array<double>>>>>>"
    each = spark.read.schema(schema).json(path).select(group, F.explode("features").alias("f")).select(group, "f.properties.*", F.element_at("f.geometry.coordinates", 1).alias("ring"))
    at = lambda f, i: f(F.transform("ring", lambda p: p[i]))
    return each.select("*", at(F.array_min, 0).alias("x0"), at(F.array_min, 1).alias("y0"), at(F.array_max, 0).alias("x1"), at(F.array_max, 1).alias("y1"))
