"""Radial surfaces, quantiles with outliers, discs, error models, polygons: against brute force and planted cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.catalogue import QUERIES
from gridloom.functions import columns as C
from gridloom.operators import quantiles, radial
from gridloom.operators import uncertainty as U


def test_one_system_is_the_dense_one(spark):
    rng = np.random.default_rng(2)
    p, v, at = rng.random((60, 2)) * 50, rng.random(60), rng.random((40, 2)) * 60
    points = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(p, v, strict=True)] + [(None, 1.0, 1.0), (1.0, 2.0, None)], "x double, y double, v double")
    cells = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(at)], "k long, x double, y double")
    want = radial.value(p, radial.solve(p, v), at)
    assert {r.k: r.z for r in radial.radial_surface(points, cells).collect()} == pytest.approx(dict(enumerate(want)), rel=1e-7)
    assert {r.z for r in radial.radial_surface(points.limit(0), cells).collect()} == {None}
    one = spark.createDataFrame([(1.0, 1.0, 3.0), (1.0, 1.0, 5.0)], "x double, y double, v double")
    assert {r.z for r in radial.radial_surface(one, cells).collect()} == {4.0}


def test_tiles_follow_the_dense_surface(spark):
    """Ten times the limit: through all points, and within a tenth of the noise of the dense solution elsewhere."""
    rng = np.random.default_rng(1)
    n = 1500
    p, at = rng.random((n, 2)) * 100, rng.random((800, 2)) * 104 - 2
    noise = 0.5
    v = np.sin(p[:, 0] / 9) * 10 + p[:, 1] * 0.3 + np.cos(p[:, 1] / 7) * 5 + rng.normal(size=n) * noise
    points = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(p, v, strict=True)], "x double, y double, v double")
    cells = points.withColumn("k", F.lit(-1)).unionByName(spark.createDataFrame([(float(a), float(b), None, i) for i, (a, b) in enumerate(at)], "x double, y double, v double, k int"))
    got = radial.radial_surface(points, cells, limit=150).collect()
    assert len(got) == n + 800 and max(abs(r.z - r.v) for r in got if r.k < 0) < 1e-9
    want = radial.value(p, radial.solve(p, v), at)
    off = np.array([r.z - want[r.k] for r in got if r.k >= 0])
    assert math.sqrt((off**2).mean()) < 0.25 * noise and np.abs(off).max() < 2 * noise


@pytest.mark.parametrize("name,rows", [("r06_bias_surface", 200), ("r08_temporal_bias", 200)])
def test_surface_queries_run(spark, sf, name, rows):
    got = QUERIES[name](spark, sf).collect()
    assert len(got) == rows and (name != "r06_bias_surface" or all(abs(r.z) < 5000 for r in got))


def test_quantiles_with_outliers_and_infinities(spark, monkeypatch):
    """Buckets are cut until none holds more than the bound, unless its values are equal."""
    rng = np.random.default_rng(3)
    values = {"a": np.r_[rng.random(20_000) * 200, 1e15, np.inf], "b": np.r_[np.full(9_000, 7.0), -np.inf, 2.0**1000, rng.random(500)], "c": np.array([np.inf, np.inf, -np.inf]), "d": np.r_[10.0 ** np.arange(-40, 40, 0.25)]}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), (None, 1.0)], "k string, v double").repartition(4)
    held = []
    keep = quantiles.stored
    monkeypatch.setattr(quantiles, "stored", lambda d, name="": held.append(keep(d, name)) or held[-1])
    got = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.9}, buckets=64, most=100).collect()}
    for k, v in values.items():
        s = np.sort(v)
        for name, p in (("lo", 0.1), ("mid", 0.5), ("hi", 0.9)):
            i = (len(s) - 1) * p
            a, b = s[math.floor(i)], s[math.ceil(i)]
            assert got[k][name] == pytest.approx(a if a == b else a + (b - a) * (i - math.floor(i)), rel=1e-9, nan_ok=True)
        assert got[k].n == len(v)
    assert got[None].mid == 1.0
    last = [h for h in held if "rank" in h.columns][-1]
    assert last.where("_c > 100 and _lo < _hi").count() == 0 and len(held) > 3


def test_discs_by_brute_force(spark):
    rng = np.random.default_rng(4)
    cells = {(r, c): float(rng.normal()) for r in range(-3, 12) for c in range(17) if rng.random() > 0.1}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()] + [(50, 0, 1.0), (2, 200, None)], "r int, c int, v double")
    areas = [1.0, 5.0, 13.0, 40.0]
    want = {}
    everything = {**cells, (50, 0): 1.0}
    for area in areas:
        disc = [(i, j) for i in range(-5, 6) for j in range(-5, 6) if i * i + j * j <= area / math.pi + 1e-9]
        for r, c in everything:
            seen = [everything[r + i, c + j] for i, j in disc if (r + i, c + j) in everything]
            if len(seen) >= 0.8 * len(disc):
                want[area, r, c] = sum(seen) / len(seen)
    for stretch in (4096, 5):
        got = {(x.area, x.r, x.c): x["mean"] for x in U.disc_means(df, "v", areas, stretch=stretch).collect()}
        assert got == pytest.approx(want)
    assert len(U.log_areas(25.0, 5e8)) == 15 and U.log_areas(25.0, 5e8)[-1] == pytest.approx(5e8)


def test_error_model_finds_the_spread(spark):
    """Residuals whose spread grows with two variables: the model gives it back, and standardised values have a spread of one."""
    rng = np.random.default_rng(5)
    x, y = rng.random(6000) * 10, rng.random(6000) * 4
    true = 1 + 0.3 * x + 0.5 * y
    e = rng.normal(size=6000) * true
    e[::300] = 500
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, e, strict=True)], "x double, y double, e double")
    got = U.error_model(df, df, "e", ["x", "y"], 6).toPandas()
    want = 1 + 0.3 * got.x + 0.5 * got.y
    assert (abs(got.err / want - 1)).quantile(0.9) < 0.2
    z = got.e / got.err
    assert 1.4826 * (z - z.median()).abs().median() == pytest.approx(1, abs=0.02)


def test_bins_and_corners_by_hand(spark):
    edges = {"x": [0.0, 2.0, 4.0], "y": [0.0, 1.0]}
    bins = U.filled_bins(spark.createDataFrame([(0, 0, 9, 1.0), (1, 0, 9, 3.0), (None, 0, 50, 8.0)], "b0 int, b1 int, n long, nmad double"), edges)
    at = spark.createDataFrame([(x, 0.7) for x in (-5.0, 1.0, 2.0, 2.5, 3.0, 9.0)], "x double, y double")
    assert [r.err for r in U.interpolated(at, bins, edges, "err").orderBy("x").collect()] == [1.0, 1.0, 2.0, 2.5, 3.0, 3.0]
    thin = U.filled_bins(spark.createDataFrame([(0, 0, 4, 1.0), (1, 0, 5, 3.0)], "b0 int, b1 int, n long, nmad double"), edges)
    assert sorted((r.b0, r.nmad) for r in thin.collect()) == [(0, 3.0), (1, 3.0)]
    b = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.9, 2.0, 4.0, 4.1, None)], "x double").select("x", U.bin_of("x", [0.0, 2.0, 4.0]).alias("b"))
    assert [r.b for r in b.collect()] == [None, 0, 0, 1, 1, None, None]


def test_polygons_are_burned_and_joined_as_by_the_ring_test(spark):
    rng = np.random.default_rng(6)
    rings = []
    for k in range(25):
        n, cx, cy = rng.integers(3, 9), rng.random() * 20, rng.random() * 20
        a = np.sort(rng.random(n)) * 2 * math.pi
        d = rng.random(n) * 6 + 0.5
        rings.append((k, [(float(cx + r * math.cos(t)), float(cy + r * math.sin(t))) for r, t in zip(d, a, strict=True)]))
    rings += [(50, [(2.0, 2.0), (12.0, 2.0), (12.0, 12.0), (2.0, 12.0), (2.0, 2.0)]), (50, [(5.0, 5.0), (8.0, 5.0), (8.0, 8.0), (5.0, 8.0)]), (51, [(1.0, 1.0), (2.0, 2.0)])]  # a hole; no area
    df = spark.createDataFrame(rings, "k int, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(r, c, c + 0.5, r + 0.5) for r in range(-8, 30) for c in range(0, 28)], "r int, c int, x double, y double")
    tested = points.join(df).where(C.in_ring("x", "y", "ring")).groupBy("k", "r", "c").count().where("count % 2 = 1")
    want = {(x.k, x.r, x.c) for x in tested.collect()}
    burned = [(x.k, x.r, x.c) for x in U.burned(df, ["k"], (0, 27)).where("r between -8 and 29").collect()]
    joined = [(x.k, x.r, x.c) for x in U.within(points, df, ["k"], 3.0).collect()]
    assert len(want) > 300 and sorted(burned) == sorted(want) == sorted(joined) and (50, 6, 6) not in want and (50, 3, 3) in want
