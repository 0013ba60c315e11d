"""Tiles kept up to date from a stream of observation files.

Every micro-batch appends its observations to a store by blocks of tiles and recomputes the medians of the blocks it touched,
replacing their folders. A batch that is given twice (after a failure) replaces its own part of the store, so it counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.files import by_block

TILE_ROWS = 8
FOLDERS = ("br", "bc")


def medians(obs: DataFrame) -> DataFrame:
    return obs.groupBy(*FOLDERS, "tr", "r", "c", "yr").agg(F.round(F.median("z"), 9).alias("z"), F.count("z").alias("n"))


def refresh(source: str, schema: str, store: str, out: str, checkpoint: str, spark: SparkSession, files_per_batch: int = 1) -> DataFrame:
    """Take all files of ``source`` (Parquet: r, c, yr, z) that haven't been taken yet; the tiles as they stand afterwards."""

    def one(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        tiled = batch.withColumn("tr", F.floor(F.col("r") / TILE_ROWS).cast("int")).withColumn("batch", F.lit(number).cast("long"))
        write = lambda df, path, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
        write(by_block(tiled), store, "batch", *FOLDERS)
        written = own.read.parquet(store)
        touched = written.where(F.col("batch") == number).select(*FOLDERS).distinct()
        write(medians(by_block(written.join(touched, list(FOLDERS), "left_semi"))), out, *FOLDERS)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
