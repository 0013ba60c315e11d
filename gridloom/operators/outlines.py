"""Outlines between two dates: boundary points valued 0 and 1, a radial surface through them, a threshold per share of time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import radial
from gridloom.operators import uncertainty as U
from gridloom.sources.files import stored


def boundary_points(rings: DataFrame, key: str, step: float, most: int) -> DataFrame:
    """(key, x, y): places along every ring of a key, ``step`` apart; farther apart if a key would have over ``most``."""
    e = U.edges_of(rings.select(key, "ring"), [key], level=True)
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    e = e.withColumn("length", length).where("length > 0")
    total = e.groupBy(key).agg((F.sum("length") / most).alias("least"), F.count("*").alias("edges"))
    e = e.join(total, key).withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("length") / F.greatest(F.lit(float(step)), F.col("least")))).cast("int"))
    e = e.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("t", F.col("t") / F.col("n"))
    at = lambda a, b: F.col(a) + F.col("t") * (F.col(b) - F.col(a))
    return e.select(key, at("x1", "x2").alias("x"), at("y1", "y2").alias("y"))


def morphed(before: DataFrame, after: DataFrame, shares: list[float], key: str, cols: tuple[int, int], step: float = 1.0, most: int = radial.LIMIT // 2) -> DataFrame:
    """before, after: key and ``ring`` (polygons by key). (key, share, r, c) of the cells inside the outline at each share of the time.

    The surface is 0 along the first outline where it isn't also the second's, 1 along the second; only the cells of one outline
    but not of both change, from the lowest value on. At 0 the first outline stands, at 1 the second, exactly. A key's points are
    ``most`` per outline, so that its system is bounded; its changing cells are one task's.
    """
    pre, post = U.burned(before, [key], cols).withColumn("pre", F.lit(True)), U.burned(after, [key], cols).withColumn("post", F.lit(True))
    cells = stored(pre.join(post, [key, "r", "c"], "full").select(key, "r", "c", F.coalesce("pre", F.lit(False)).alias("pre"), F.coalesce("post", F.lit(False)).alias("post")), "cells")
    change = cells.where("pre <> post").select(key, "r", "c", (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"))
    points = boundary_points(before, key, step, most).withColumn("v", F.lit(0.0)).unionByName(boundary_points(after, key, step, most).withColumn("v", F.lit(1.0)))
    # places that both outlines have bound nothing that changes
    points = points.groupBy(key, "x", "y").agg(F.max("v").alias("v"), F.countDistinct("v").alias("n")).where("n = 1").drop("n")

    def value(cells: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros(len(cells))
        if len(cells) and len(bounds):
            bounds = bounds.sort_values(["x", "y"])
            p = bounds[["x", "y"]].to_numpy(float)
            z = np.clip(radial.value(p, radial.solve(p, bounds.v.to_numpy(float)), cells[["x", "y"]].to_numpy(float)), 0.0, 1 - 1e-9)
        return pd.DataFrame({key: cells[key], "r": cells.r, "c": cells.c, "z": z})

    kind = dict(cells.dtypes)[key]
    z = change.groupBy(key).cogroup(points.groupBy(key)).applyInPandas(value, f"{key} {kind}, r int, c int, z double")
    every = cells.join(z, [key, "r", "c"], "left").withColumn("share", F.explode(F.array(*map(F.lit, map(float, shares)))))
    inside = F.col("pre") != (F.col("z").isNotNull() & (F.col("z") < F.col("share")))
    return every.where(inside).select(key, "share", "r", "c")
