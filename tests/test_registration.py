"""Co-registration, outlines in between, rolling lines, farthest points: planted cases and brute force."""

import math

import numpy as np
import pytest

from gridloom.catalogue import QUERIES
from gridloom.operators import outlines as O
from gridloom.operators import registration as R
from gridloom.operators import solvers as V
from gridloom.plans import solvers as plans
from gridloom.sources import adapters


def plane_cost(obs, planes, centre):
    """The joint cost in plain Python."""
    total, cells = 0.0, {}
    for d, x, y, z, ref in obs:
        a, b, c = planes[d]
        v = z + a * (x - centre[d][0]) + b * (y - centre[d][1]) + c
        cells.setdefault((x, y), []).append(v)
        total += 0.0 if ref is None else math.sqrt(1 + 9 * (v - ref) ** 2) - 1
    return total + sum(math.sqrt(1 + (v - np.median(vs)) ** 2) - 1 for vs in cells.values() for v in vs)


def test_planes_of_all_years_at_once(spark):
    """Planted planes come back from a start far off, in two years with their own; the cost is the plain one."""
    shift = {1: (0.0, 0.0, 5.0), 2: (0.1, -0.1, -3.0), 3: (-0.3, 0.2, 40.0)}
    rows = {}
    for yr, k in ((1, 1.0), (2, -0.5)):
        rows[yr] = [(d, i, j, 100 + i * 0.5 - j - k * (a * (i - 5.5) + b * (j - 5.5) + c), 100 + i * 0.5 - j if (i + j) % 3 == 0 else None) for d, (a, b, c) in shift.items() for i in range(12) for j in range(12)]
    df = spark.createDataFrame([(yr, d, i, j, float(z), None if f is None else float(f)) for yr, each in rows.items() for d, i, j, z, f in each], "yr int, dem long, x int, y int, z double, ref double")
    got = {(r.yr, r.dem): r for r in R.joint_planes(df, rounds=16).collect()}
    for yr, k in ((1, 1.0), (2, -0.5)):
        for d, plane in shift.items():
            r = got[yr, d]
            assert (r.a, r.b, r.c) == pytest.approx(tuple(k * p for p in plane), abs=0.05) and (r.cx, r.cy) == (5.5, 5.5)
        planes = {d: (got[yr, d].a, got[yr, d].b, got[yr, d].c) for d in shift}
        assert got[yr, 1].cost == pytest.approx(plane_cost(rows[yr], planes, dict.fromkeys(shift, (5.5, 5.5))), rel=1e-6, abs=1e-6) and got[yr, 1].cost < 20


def test_rigid_shifts_are_found_for_all_strips(spark, sf):
    obs, ref, dems = (getattr(adapters, v)(spark, "/root/testdata/sf0.01") for v in ("obs", "ref", "dems"))
    surface, strips = plans.shifted_strips(obs, ref, dems)
    want = {r.dem: (r.sx, r.sy) for r in strips.select("dem", "sx", "sy").distinct().collect()}
    got = {r.dem: r for r in R.rigid_shifts(strips, surface, rounds=4).collect()}
    assert got.keys() == want.keys() and max(abs(x) + abs(y) for x, y in want.values()) > 2
    assert all(abs(got[d].dx - x) < 0.1 and abs(got[d].dy - y) < 0.1 and got[d].after <= got[d].before + 1e-9 for d, (x, y) in want.items())


def test_rigid_shifts_go_on_until_small(spark):
    """A strip nine cells off, beyond the window and all halos; one that goes on after five rounds; one that is nowhere on the reference."""
    rise = lambda x, y: 40 * np.sin(x / 8) + 30 * np.cos(y / 10)
    surface = spark.createDataFrame([(r, c, float(rise(c, r))) for r in range(64) for c in range(64)], "r int, c int, z double")
    rng, want = np.random.default_rng(5), {"far": (9.3, -7.6, 30.0), "near": (0.6, -0.6, 2.0)}
    points = [(d, float(x), float(y), float(rise(x + dx, y + dy) + dz + rng.normal(0, 0.01) + (200 if rng.random() < 0.05 else 0))) for d, (dx, dy, dz) in want.items() for x, y in rng.uniform(16, 46, (600, 2))]
    off = [("off", 500.0 + i, 500.0, 1.0) for i in range(9)]
    df = spark.createDataFrame(points + off, "dem string, x double, y double, z double")
    got = {r.dem: r for r in R.rigid_shifts(df, surface).collect()}
    assert got.keys() == {"far", "near", "off"}
    assert got["off"].n == 0 and got["off"].dx is None and not got["off"].settled
    for d, shift in want.items():
        assert (got[d].dx, got[d].dy, got[d].dz) == pytest.approx(shift, abs=0.1) and got[d].n == 600 and got[d].settled and got[d].after < got[d].before


def test_points_on_cells_of_the_rim_count(spark):
    """On a cell's centre the missing cell beside it has no weight."""
    surface = spark.createDataFrame([(r, c, float(3 * c + 2 * r + c * r % 5)) for r in range(12) for c in range(12)], "r int, c int, z double")
    df = spark.createDataFrame([("a", float(c), float(r), float(3 * c + 2 * r + c * r % 5)) for r in range(1, 11) for c in range(1, 11)], "dem string, x double, y double, z double")
    got = R.rigid_shifts(df, surface).collect()
    assert len(got) == 1 and got[0].n == 100 and (got[0].dx, got[0].dy, got[0].dz) == pytest.approx((0, 0, 0), abs=1e-9)


def test_outlines_grow_from_the_first_to_the_second(spark):
    ring = lambda cx, cy, size: [(cx + size * math.cos(a), cy + size * math.sin(a)) for a in np.arange(8) * math.pi / 4]
    frame = lambda rows: spark.createDataFrame(rows, "g int, ring array<struct<x: double, y: double>>")
    before, after = frame([(1, ring(10.2, 10.1, 3)), (2, ring(30.0, 8.0, 6)), (3, ring(50.0, 8.0, 2))]), frame([(1, ring(10.9, 10.4, 7)), (2, ring(30.0, 8.0, 2)), (3, ring(56.0, 8.0, 2))])
    shares = [0.0, 0.3, 0.6, 1.0]
    cells = {}
    for r in O.morphed(before, after, shares, "g", (0, 70)).collect():
        cells.setdefault((r.g, r.share), set()).add((r.r, r.c))
    from gridloom.operators import uncertainty as U

    for frame_, share in ((before, 0.0), (after, 1.0)):
        want = {}
        for r in U.burned(frame_, ["g"], (0, 70)).collect():
            want.setdefault((r.g, share), set()).add((r.r, r.c))
        assert all(cells[k] == v for k, v in want.items())
    for a, b in zip(shares, shares[1:], strict=False):
        assert cells[1, a] < cells[1, b] and cells[2, a] > cells[2, b]  # one grows, the other shrinks


def test_rolling_lines_leave_outliers_out(spark):
    rows = [(0, t, 2.0 * t + 1 + (100 if t == 5 else 0)) for t in range(9)] + [(1, 0, 1.0), (1, 1, None), (1, 2, 5.0)]
    got = V.rolling_ransac(spark.createDataFrame(rows, "k int, t int, y double"), ["k"], "t", "y", width=4).orderBy("t0").collect()
    assert [r.t0 for r in got] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and {r.k for r in got} == {0}
    assert all((r.slope, r.intercept) == pytest.approx((2, 1)) and r.n_in == (4 if r.t0 < 2 else 3) for r in got)


def test_farthest_points_by_brute_force(spark):
    xy = np.random.default_rng(1).random((50, 2))
    taken = [r.pid for r in V.farthest_points(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "pid long, x double, y double"), 8).orderBy("place").collect()]
    assert taken[0] == 0
    for k in range(1, 8):
        near = ((xy[:, None] - xy[taken[:k]]) ** 2).sum(-1).min(1)
        assert taken[k] == int(near.argmax())
    assert V.farthest_points(spark.createDataFrame([(1, 0.0, 0.0)], "pid long, x double, y double"), 5).count() == 1


@pytest.mark.parametrize("name", ["r09_joint_planes", "r11_track_shifts", "r26_outline_morph", "r28_block_polynomials", "r35_gap_classifier", "r38_variogram_fit"])
def test_queries_without_sql_run(spark, sf, name):
    got = QUERIES[name](spark, sf).collect()
    assert got and (name != "r38_variogram_fit" or got[0].reach > 0)


def test_balanced_points_fill_the_bins(spark):
    """Pair distances are flatter than those of as many points by chance; a seed fixes the choice."""
    xy = np.random.default_rng(7).random((900, 2)) * 40
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "pid long, x double, y double").repartition(4)
    got = V.balanced_points(df, 6, 20, 4.0, 10).toPandas()
    again = V.balanced_points(df.repartition(7), 6, 20, 4.0, 10).toPandas()
    key = ["rep", "place"]
    assert got.sort_values(key).pid.tolist() == again.sort_values(key).pid.tolist() and (got.groupby("rep").pid.nunique() == 20).all()
    rng = np.random.default_rng(8)
    uneven = lambda c: c.std() / c.mean()
    chance = np.mean([uneven(V.pair_bins(xy[rng.choice(900, 20, replace=False)], 4.0, 10)) for _ in range(30)])
    assert np.mean([uneven(V.pair_bins(g[["x", "y"]].to_numpy(), 4.0, 10)) for _, g in got.groupby("rep")]) < 0.75 * chance
    assert V.balanced_points(df.limit(3), 2, 20, 4.0, 10).count() == 6


def test_filling_from_quadrants_by_hand(spark):
    from gridloom.operators import surface as S

    rows = [(0, 0, 4.0), (0, 1, None), (0, 2, None), (0, 3, 10.0), (1, 0, None), (1, 1, None), (1, 2, 7.0), (1, 3, None), (9, 9, None)]
    got = {(r.r, r.c): r.z for r in S.inverse_distance_fill(spark.createDataFrame(rows, "r int, c int, z double"), "z", search=3).collect()}
    assert got[0, 0] == 4.0 and got[9, 9] is None
    # left (4 at 1), right and below (7 at sqrt 2); 10 lies behind in the same quadrant
    assert got[0, 1] == pytest.approx((4 + 7 / 2**0.5) / (1 + 1 / 2**0.5))
    assert got[0, 2] == pytest.approx((4 / 2 + 10 / 1 + 7 / 1) / (1 / 2 + 1 + 1))
