"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and get the fractional rank (rank - 1/2) / rows of the source.
In the order of fractional ranks every stretch holds the sources in the corpus's proportions, so cutting that order
into equal stretches gives shards that match the mixture, with counts at most one apart (law ``rows``).

No window over rows spans a source or the table: ranks are counted in ``cells`` ranges of the hash (fraction) and shifted by
the counts of the ranges before; only these counts, a row per cell (CELL_ROWS rows) and source, are summed up by source and,
for the fractions, in one window. Texts may be of any length (they aren't read); an empty table has no shards. A null source is a source of its own; null ids and equal
rows are ordered by the other columns given, and rows equal in all of these are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of a cell, on average, at most.
CELL_ROWS = 20_000


def _ranked(df: DataFrame, group: list[str], cell: str, order: list[str], name: str) -> DataFrame:
    """``name``: the rank (from 1) of each row of ``group`` in the order of (cell, order), where ``order`` refines cell."""
    counts = df.groupBy(*group, cell).agg(F.count("*").alias("_n"))
    ahead = W.partitionBy(*group).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    keys = [*group, cell]
    counts = counts.select("_ahead", *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    within = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_w", within).join(counts, on).withColumn(name, F.col("_w") + F.col("_ahead")).drop("_w", "_ahead", *(f"_k{i}" for i in range(len(keys))))


def interleave(df: DataFrame, shards: int, source: str = "source", keys: tuple[str, ...] = ("doc_id",), seed: int = 17, cell_rows: int = CELL_ROWS) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in a shard).

    ``keys`` identify rows and break ties. Columns of ``df`` named shard or slot are replaced; the others travel as one struct, so that
    no name can clash with those used here.
    """
    df = df.drop("shard", "slot")
    total = df.count()
    if not total:
        return df.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    cells = -(-total // cell_rows)
    held = df.columns
    df = df.select(F.struct(*held).alias("_row"), F.col(source).alias("_s"), *(F.col(k).alias(f"_i{i}") for i, k in enumerate(keys)))
    keys = [f"_i{i}" for i in range(len(keys))]
    df = df.withColumn("_h", F.xxhash64(F.lit(seed), *keys))
    df = df.withColumn("_cell", F.floor((F.shiftrightunsigned("_h", 11) / float(1 << 53)) * cells))
    # the unsigned order of the hash refines its cell
    df = df.withColumn("_u", F.shiftrightunsigned("_h", 1))
    df = _ranked(df, ["_s"], "_cell", ["_u", "_h", *keys], "_rank")
    sizes = df.groupBy("_s").agg(F.count("*").alias("_rows")).withColumnRenamed("_s", "_s2")
    df = df.join(sizes, F.col("_s").eqNullSafe(F.col("_s2"))).drop("_s2")
    # equal fractions (2 rank - 1 over 2 rows) of different sources are ordered by the row's hash
    df = df.withColumn("_f", (F.col("_rank") - 0.5) / F.col("_rows"))
    df = df.withColumn("_cell", F.floor(F.col("_f") * cells))
    df = df.withColumn("_all", F.lit(0))
    df = _ranked(df, ["_all"], "_cell", ["_f", "_u", "_h", *keys], "_place")
    at = F.col("_place") - 1
    base, extra = divmod(total, shards)
    wide = extra * (base + 1)  # the first ``extra`` shards have a row more
    if base:
        shard = F.when(at < wide, F.floor(at / (base + 1))).otherwise(extra + F.floor((at - wide) / base))
        slot = F.when(at < wide, at % (base + 1)).otherwise((at - wide) % base)
    else:
        shard, slot = at, F.lit(0)
    return df.select(*(F.col("_row")[c].alias(c) for c in held), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int, **options) -> None:
    """The shards as Parquet folders ``shard=N`` under ``path``, rows in the order of their slots within a file."""
    placed = interleave(df, shards, **options)
    placed.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
