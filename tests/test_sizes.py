"""What a larger table would make of a step, seen on small ones: files, rows of a shuffle, tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.operators import registration as R
from gridloom.operators import solvers as V
from gridloom.operators import uncertainty as U
from gridloom.plans import products, solvers
from gridloom.sources import cubes, files
from gridloom.streaming import tiles


def grid(spark, rows: int, cols: int, parts: int = 4):
    """Observations of every cell in two years, three each."""
    df = spark.range(rows * cols * 6, numPartitions=parts).select(F.floor(F.col("id") / 6).alias("k"), (F.col("id") % 2).cast("int").alias("yr"), (F.hash("id") % 1000).cast("double").alias("z"))
    return df.select(F.floor(F.col("k") / cols).cast("int").alias("r"), (F.col("k") % cols).cast("int").alias("c"), "yr", "z")


def test_cube_has_a_file_for_a_block_of_chunks(spark, tmp_path):
    obs, path = grid(spark, 256, 16), str(tmp_path / "cube")
    assert cubes.refresh_cube(obs, path) == 64
    assert len(list((tmp_path / "cube" / "cube").rglob("*.parquet"))) == 256 // files.BLOCK
    more = obs.unionByName(spark.createDataFrame([(200, 3, 0, 1e6)], obs.schema))
    assert cubes.refresh_cube(more, path) == 1 and cubes.refresh_cube(more, path) == 0
    want = {tuple(x) for x in more.groupBy("r", "c", "yr").agg(F.median("z")).collect()}
    assert {(x.r, x.c, x.yr, x.z) for x in spark.read.parquet(f"{path}/cube").collect()} == want


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_points_meet_their_patch_without_copies(spark, monkeypatch, bound):
    """Shifts across the borders of patches, with few points to a row of them, broadcast or not."""
    monkeypatch.setattr(R, "PATCH", 16)
    monkeypatch.setattr(R, "PATCH_POINTS", 100)
    monkeypatch.setattr(R, "SHIFTS", bound)
    rise = lambda x, y: 40 * np.sin(x / 4) + 30 * np.cos(y / 5)
    surface = spark.createDataFrame([(r, c, float(rise(c, r))) for r in range(40) for c in range(40) if (r, c) != (20, 20)], "r int, c int, z double")
    rng, want = np.random.default_rng(3), {0: (1.6, -0.7, 3.0), 1: (-2.3, 1.2, -5.0)}
    points = [(d, float(x), float(y), float(rise(x + dx, y + dy) + dz)) for d, (dx, dy, dz) in want.items() for x, y in rng.uniform(2, 37, (800, 2))]
    df = spark.createDataFrame(points, "dem long, x double, y double, z double")
    chunks = R.with_patches(df, R.with_gradient(surface, "z"), 8)
    assert chunks.select(F.sum(F.size("p"))).first()[0] == 1600 and chunks.count() >= 16 and chunks.agg(F.max(F.size("p"))).first()[0] < 250
    got = {r.dem: r for r in R.rigid_shifts(df, surface).collect()}
    for d, shift in want.items():
        assert (got[d].dx, got[d].dy, got[d].dz) == pytest.approx(shift, abs=0.1)
        inside = [(x + got[d].dx, y + got[d].dy) for k, x, y, _ in points if k == d]
        lost = lambda u, v: any((i, j) in {(20, 20), (19, 20), (21, 20), (20, 19), (20, 21)} for i in (int(v), int(v) + 1) for j in (int(u), int(u) + 1))
        n = sum(1 <= u < 38 and 1 <= v < 38 and not lost(u, v) for u, v in inside)
        assert abs(got[d].n - n) <= 3


def test_first_of_each_orders_few_rows(spark):
    """The rows that a window over all would number first, ties by pid, from far fewer ordered rows; replicates aren't one task's."""
    df = V.replicated(spark.range(20_000, numPartitions=1).withColumnRenamed("id", "pid"), 5)
    assert df.rdd.getNumPartitions() > 1
    h = df.withColumn("u", F.xxhash64("rep", F.floor(F.col("pid") / 3)))
    order = W.partitionBy("rep").orderBy("u", "pid")
    want = {tuple(x) for x in h.withColumn("k", F.row_number().over(order)).where("k <= 50").select("rep", "pid", "k").collect()}
    got = V.first_of_each(h, "rep", "u", 52, "pid", 50)
    assert {tuple(x) for x in got.select("rep", "pid", "k").collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_last" in plan and V.first_of_each(h.where("pid < 20"), "rep", "u", 52, "pid", 50).count() == 100


def test_stream_has_a_file_for_a_block(spark, tmp_path):
    obs, path = grid(spark, 256, 16), lambda x: str(tmp_path / x)
    obs.coalesce(1).write.parquet(path("in"))
    got = tiles.refresh(path("in"), "r int, c int, yr int, z double", path("store"), path("out"), path("check"), spark)
    assert got.count() == 256 * 16 * 2
    assert len(list((tmp_path / "out").rglob("*.parquet"))) == len(list((tmp_path / "store").rglob("*.parquet"))) == 256 // files.BLOCK


def shuffled(spark) -> int:
    """Records that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_planes_shuffle_observations_once(spark, monkeypatch):
    """Further rounds send strips, not observations; blocks and rows of them change nothing."""
    df = spark.range(5 * 40 * 40, numPartitions=4).select(
        F.lit(1990).alias("yr"), (F.col("id") % 5).alias("dem"), F.floor(F.col("id") / 5 % 40).cast("int").alias("x"), F.floor(F.col("id") / 200).cast("int").alias("y"),
        (F.hash("id") % 100 / 10.0).alias("z"), F.when(F.col("id") % 3 == 0, F.lit(1.0)).alias("ref"),
    )
    counts, planes = [shuffled(spark)], []
    for rounds in (1, 3):
        planes = sorted(map(tuple, R.joint_planes(df, rounds=rounds).collect()))
        counts.append(shuffled(spark))
    assert counts[2] - counts[1] < counts[1] - counts[0] + 2000 and len(planes) == 5
    monkeypatch.setattr(R, "BLOCK", 16)
    monkeypatch.setattr(R, "BLOCK_OBS", 500)
    small = sorted(map(tuple, R.joint_planes(df, rounds=3).collect()))
    assert all(a == pytest.approx(b, rel=1e-6, abs=1e-6) for a, b in zip(small, planes, strict=True))


def test_spread_strips_meet_few_parts(spark, monkeypatch):
    """A strip that lies all over the grid is sent to a bounded number of parts, not to every block; planes stay."""
    monkeypatch.setattr(R, "BLOCK", 4)
    monkeypatch.setattr(R, "BLOCK_OBS", 50)
    df = spark.range(5 * 40 * 40, numPartitions=4).select(
        (1990 + F.col("id") % 2).cast("int").alias("yr"), F.concat(F.lit("s"), F.col("id") % 5).alias("dem"), F.floor(F.col("id") / 5 % 40).cast("int").alias("x"), (F.floor(F.col("id") / 200) - 7).cast("int").alias("y"),
        (F.hash("id") % 100 / 10.0).alias("z"), F.when(F.col("id") % 3 == 0, F.lit(1.0)).alias("ref"),
    )
    blocks, buckets = R._blocked(df)
    strips = R._strips(blocks)
    parts = blocks.select("yr", "part").distinct().count()
    assert blocks.count() >= 200 and 2 <= parts <= 1.5 * spark.sparkContext.defaultParallelism + 2 and buckets >= parts
    assert strips.count() == 10 and strips.agg(F.max(F.size("parts"))).first()[0] <= parts / 2
    want = {(x.yr, x.dem): (x.cx, x.cy) for x in df.groupBy("yr", "dem").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).collect()}
    assert {(x.yr, x.dem): (x.cx, x.cy) for x in strips.collect()} == want
    at = strips.select("yr", "dem", "parts", "cx", "cy", F.lit(0.1).alias("ta"), F.lit(-0.2).alias("tb"), F.lit(3.0).alias("tc"))
    small = {(x.yr, x.dem): x for x in R._evaluated(blocks, buckets, at, 3.0).collect()}
    plan = R._evaluated(blocks, buckets, at, 3.0)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ShuffledHashJoin" in plan and "Sort " not in plan and plan.count("Exchange") == 2  # strips there, sums back
    monkeypatch.setattr(R, "BLOCK", 1024)
    monkeypatch.setattr(R, "BLOCK_OBS", 1 << 19)
    blocks, buckets = R._blocked(df)
    assert blocks.count() == 2 + 2  # one for the rows below 0
    whole = {(x.yr, x.dem): x for x in R._evaluated(blocks, buckets, R._strips(blocks).join(at.drop("parts", "cx", "cy"), ["yr", "dem"]), 3.0).collect()}
    assert small.keys() == whole.keys() and all(small[k][n] == pytest.approx(whole[k][n], rel=1e-9, abs=1e-9) for k in small for n in R.STRIP_SUMS)


def test_discs_meet_blocks_not_rows(spark):
    """A cell is sent to the blocks within its reach, not to every row that has it in a disc; blocks' borders change nothing."""
    df = spark.range(640 * 4, numPartitions=4).select(F.floor(F.col("id") / 4).cast("int").alias("r"), (F.col("id") % 4 + 100).cast("int").alias("c"), (F.hash("id") % 100 / 7.0).alias("v"))
    before = shuffled(spark)
    got = {(x.r, x.c): x["mean"] for x in U.disc_means(df, "v", [250.0], least=0.0).collect()}
    assert shuffled(spark) - before < 2 * 640 * 4
    v = {(x.r, x.c): x.v for x in df.collect()}
    for r, c in ((0, 100), (63, 103), (64, 100), (127, 101), (639, 102)):
        seen = [v[k, j] for k in range(r - 9, r + 10) for j in range(100, 104) if (k, j) in v and (k - r) ** 2 + (j - c) ** 2 <= 250 / np.pi + 1e-9]
        assert got[r, c] == pytest.approx(np.mean(seen))


def test_mosaic_shuffles_observations_once(spark, monkeypatch):
    """All stacks of a cell and year come from one shuffle, at any size of blocks; a cell without values keeps its row."""
    rows = spark.range(6000, numPartitions=4).select(
        F.floor(F.col("id") / 10 % 20).cast("int").alias("r"), (F.col("id") % 10).cast("int").alias("c"), (F.col("id") % 3 + 1995).cast("int").alias("yr"), F.abs(F.hash("id", F.lit(1)) % 90).cast("long").alias("dem_id"),
        F.when(F.hash("id") % 7 != 0, F.hash("id") % 500 / 3.0).alias("z"), F.date_add(F.lit("1995-01-01"), F.abs(F.hash("id") % 365)).alias("d"),
    ).where("dem_id % 4 <> 0 or r < 8")
    before = shuffled(spark)
    got = {(x.r, x.c, x.yr): x for x in products.stacks_by_source(rows).collect()}
    assert shuffled(spark) - before == rows.count()
    monkeypatch.setattr(products, "BLOCK", 8)
    assert {(x.r, x.c, x.yr): x for x in products.stacks_by_source(rows).collect()} == got
    held = {}
    for x in rows.collect():
        for name in (products.SOURCES[x.dem_id % 4][0], "all"):
            held.setdefault((x.r, x.c, x.yr), {}).setdefault(name, []).append((x.z, x.d.timetuple().tm_yday))
    assert held.keys() == got.keys()
    first = {(r // 8, c // 8, yr) for (r, c, yr), s in held.items() if "vertcoreg" in s}
    for k, sources in held.items():
        assert got[k].covered == ((k[0] // 8, k[1] // 8, k[2]) in first)
        for name in (*(s[0] for s in products.SOURCES), "all"):
            x, v = got[k][name], np.array([z / 20 for z, _ in sources.get(name, ()) if z is not None])
            if name not in sources:
                assert x is None
                continue
            assert x.n == len(v) and x.doy == np.median([d for _, d in sources[name]])
            want = (np.median(v), 1.4826 * np.median(np.abs(v - np.median(v)))) if len(v) else (None, None)
            assert (x.median, x.nmad) == (pytest.approx(want) if len(v) else want)


def test_rolling_lines_shuffle_observations_once(spark):
    """Yearly medians and series by cell need one shuffle; windows of a batch fitted together are those fitted alone."""
    out = solvers.r30_rolling_ransac(grid(spark, 8, 8).withColumn("yr", F.col("yr") + 1995))
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1
    rng = np.random.default_rng(4)
    t, y = np.sort(rng.random((50, 4)), 1), rng.integers(0, 3, (50, 4)).astype(float)
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    slope, intercept, n = V.window_lines(t, y, pairs)
    for k in range(50):
        limit, draws = np.median(np.abs(y[k] - np.median(y[k]))), []
        for i, j in pairs:
            off = np.abs(y[k] - y[k, i] - (y[k, j] - y[k, i]) / (t[k, j] - t[k, i]) * (t[k] - t[k, i]))
            near = off <= limit + 1e-9
            draws.append((-near.sum(), round(off[near].sum(), 9), (i, j), near))
        near = min(draws, key=lambda d: d[:3])[3]
        assert n[k] == near.sum() and (slope[k], intercept[k]) == pytest.approx(tuple(np.polyfit(t[k, near], y[k, near], 1)), rel=1e-5, abs=1e-6)


def test_blocks_leave_out_rows_without_keys(spark):
    """Observations without a place, year or strip; an observation of no source counts in the stack of all."""
    day = F.lit("1996-02-03").cast("date").alias("d")
    rows = [(0, 0, 1996, 4, 20.0), (0, 0, 1996, None, 60.0), (None, 0, 1996, 4, 1.0), (0, 1, None, 4, 1.0)]
    x = products.stacks_by_source(spark.createDataFrame(rows, "r int, c int, yr int, dem_id long, z double").select("*", day)).collect()
    assert len(x) == 1 and x[0].vertcoreg.median == 1.0 and x[0]["all"].median == 2.0 and x[0]["all"].n == 2
    planes = [(1990, "a", 0, 0, 1.0, 1.0), (1990, "b", 1, 0, 3.0, None), (1990, None, 1, 0, 3.0, None), (1990, "b", None, 0, 3.0, None), (1990, "b", 2, 2, None, None)]
    df = spark.createDataFrame(planes, "yr int, dem string, x int, y int, z double, ref double")
    assert sorted((p.dem, p.cx) for p in R.joint_planes(df, rounds=1).collect()) == [("a", 0.0), ("b", 1.0)]
    assert R.joint_planes(df.limit(0), rounds=1).count() == 0
