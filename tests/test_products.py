"""Cubes by chunks, the classifier's importances, rules computed by hand."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.catalogue import QUERIES
from gridloom.operators import surface as S
from gridloom.plans import products, solvers
from gridloom.sources import cubes


def test_only_changed_chunks_are_made_again(spark, tmp_path):
    rows = [(r, c, yr, float(r + c + yr)) for r in (0, 9) for c in (0, 8) for yr in (1, 2)]
    frame = lambda rows: spark.createDataFrame(rows, "r int, c int, yr int, z double")
    path = str(tmp_path / "cube")
    written = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "cube" / "cube").rglob("*.parquet")}
    assert cubes.refresh_cube(frame(rows), path) == 4
    first = written()
    assert cubes.refresh_cube(frame(rows[::-1]), path) == 0 and written() == first
    more = [*rows, (9, 8, 3, 7.0)]
    assert cubes.refresh_cube(frame(more), path) == 1
    after = written()
    assert sum(p not in after for p in first) == 1 and cubes.refresh_cube(frame(more), path) == 0
    got = {(x.r, x.c, x.yr): x.z for x in spark.read.parquet(f"{path}/cube").collect()}
    assert len(got) == 64 * (3 * 2 + 3) and got[9, 8, 3] == 7.0 and got[9, 8, 1] == 18.0 and got[8, 8, 3] is None
    assert cubes.refresh_cube(frame(more[1:]), path) == 1  # a value that went


def test_importance_of_planted_features(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        a, b, c = rng.random(), None if rng.random() < 0.2 else rng.random(), rng.random()
        rows.append((i, a, b, c, float((a > 0.5) if b is None else (b > 0.5))))
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, label double").repartition(3)
    got = {r.feature: r for r in solvers.importance(df.where("k % 4 > 0"), df.where("k % 4 = 0"), ["k"], ["a", "b", "c"], repeats=6).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].accuracy > 0.9
    assert got["b"]["mean"] > 0.25 > got["a"]["mean"] > 0.02 > abs(got["c"]["mean"]) and got["b"].std > 0


def test_masks_by_hand(spark):
    """A bad cell takes its diamond with it; a part of under one hundredth of the largest goes."""
    tag = {(r, c): 1 for r in range(20) for c in range(20)} | {(0, 19): None} | {(50, c): 1 for c in range(4)} | {(60, 0): 1}
    cells = spark.createDataFrame([(r, c, t) for (r, c), t in tag.items()], "r int, c int, tag int")
    got = {(x.r, x.c): x.outlier for x in S.conditioned_mask(cells).collect()}
    near = {(r, c) for r, c in tag if abs(r) + abs(c - 19) <= 3}
    assert len(got) == len(tag) and {k for k, v in got.items() if v} == near | {(60, 0)}


def test_seam_by_hand(spark):
    """At a seam value and spread go by weight, the count is the greater, the day that of the side that weighs more."""
    obs = [(0, c, 1994, d, z, dem, f"1994-01-{dd:02d}") for c in (0, 2, 3, 9) for d, z, dem, dd in ((0, 200.0, 4, 10), (1, 220.0, 4, 20), (2, 400.0, 7, 30))]
    rows = spark.createDataFrame([(r, c, yr, z, dem, d) for r, c, yr, _, z, dem, d in obs], "r int, c int, yr int, z double, dem_id long, d string").withColumn("d", F.to_date("d"))
    ref = spark.createDataFrame([(0, c, 50 if c == 0 else 10, "Brand#11") for c in range(10)] , "r int, c int, slope int, zone string")
    got = {x.c: x for x in products.mosaic_tile(rows, ref).collect()}
    a, b = 10.5, 11.0  # medians of the first source (10, 11) and of all (10, 11, 20)
    assert got[0].z == pytest.approx(b) and got[9].z == pytest.approx(a) and got[2].z == pytest.approx(0.5 * b + 0.5 * a) and got[3].z == pytest.approx(0.25 * b + 0.75 * a)
    assert (got[0].n, got[9].n, got[3].n) == (3, 2, 3) and (got[0].doy, got[2].doy, got[3].doy, got[9].doy) == (20.0, 20.0, 15.0, 15.0)
    assert {x.quality for x in got.values()} == {4} and got[9].nmad == pytest.approx(1.4826 * 0.5) and got[0].nmad == pytest.approx(1.4826)


def test_importance_query_runs(spark, sf):
    got = QUERIES["r35_feature_importance"](spark, sf).collect()
    assert len(got) == 5 and all(0 <= r.accuracy <= 1 for r in got)


def test_numbers_by_ranges_of_ranges(spark):
    from gridloom.plans import values

    keys = random.Random(3).sample(range(5000), 400)
    got = {r.pid: r.k for r in values.numbered(spark.createDataFrame([(k,) for k in keys], "pid long").repartition(3), "pid", width=7).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_collections_are_bounded(spark, monkeypatch):
    from gridloom.sources import files

    monkeypatch.setattr(files, "FEATURES", 10)
    path = files.fresh_path(spark, "features")
    files.write_features(spark.range(95).selectExpr("id", "'a' as g", "0D as x0", "0D as y0", "1D as x1", "2D as y1"), path, "g")
    sizes = [r.n for r in spark.read.json(path).select(F.size("features").alias("n")).collect()]
    assert max(sizes) <= 10 and sum(sizes) == 95
    assert files.read_features(spark, path, "g", "id: bigint").where("x1 = 1 and y1 = 2").count() == 95
