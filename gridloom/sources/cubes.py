"""Cubes in chunks: a store that is brought up to date chunk by chunk."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.files import BLOCK, by_block, stored


def read_or_none(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if not any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        return None


def refresh_cube(obs: DataFrame, path: str, size: int = 8) -> int:
    """Write to ``path`` the chunks (``size`` x ``size`` cells) whose observations (r, c, yr, z) aren't those they were made of; how many.

    A chunk is dense: all its cells by all its years, with the median or null. Chunks are told apart by sums of their rows' hashes,
    kept beside the cube, so finished ones are skipped by an anti-join and only folders with a stale chunk are overwritten. A folder
    is a block of chunks (BLOCK cells along an axis, which ``size`` divides). A run that is cut off leaves no sums for what it hasn't
    finished, which the next run makes again.
    """
    if BLOCK % size:
        raise ValueError(f"chunks of {size} cells don't fill a block of {BLOCK}")
    spark = obs.sparkSession
    at = lambda v: F.floor(F.col(v) / size).cast("int")
    rows = obs.select(at("r").alias("tr"), at("c").alias("tc"), "r", "c", "yr", "z")
    sums = rows.groupBy("tr", "tc").agg(F.count("*").alias("n"), F.sum(F.xxhash64("r", "c", "yr", "z").cast("decimal(38,0)")).alias("mark"))
    done = read_or_none(spark, f"{path}/marks")
    if done is not None:  # runs append; a chunk's last mark counts
        last = done.groupBy("tr", "tc").agg(F.max_by(F.struct("n", "mark"), "run").alias("m")).select("tr", "tc", "m.n", "m.mark")
        run = done.agg(F.max("run")).first()[0] + 1
        stale = sums.join(last, ["tr", "tc", "n", "mark"], "left_anti")
    else:
        stale, run = sums, 0
    stale = stale.withColumn("run", F.lit(run))
    stale = stored(stale, "stale")  # what this run does is settled before anything is written
    count = stale.count()
    if count:
        # a folder holds a block of chunks, all of them made again from their observations; it is one task's from here to its file
        rows = by_block(rows)
        near = rows.join(by_block(stale.select((F.col("tr") * size).alias("r"), (F.col("tc") * size).alias("c"))).select("br", "bc").distinct(), ["br", "bc"], "left_semi")
        have = near.groupBy("br", "bc", "tr", "tc", "r", "c", "yr").agg(F.median("z").alias("z"))
        place = ((F.col("r") - F.col("tr") * size) * size + F.col("c") - F.col("tc") * size).alias("k")
        year = have.groupBy("br", "bc", "tr", "tc", "yr").agg(F.map_from_entries(F.collect_list(F.struct(place, "z"))).alias("have"))
        dense = year.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))))
        row, col = F.floor(F.col("k") / size).cast("int"), F.col("k") % size
        z = F.try_element_at("have", F.col("k")).alias("z")
        cube = dense.select("br", "bc", "tr", "tc", (F.col("tr") * size + row).alias("r"), (F.col("tc") * size + col).alias("c"), "yr", z)
        cube.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("br", "bc").parquet(f"{path}/cube")
        stale.write.mode("append").parquet(f"{path}/marks")
    return count
