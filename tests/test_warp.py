"""Warps: projections there and back, exclusive arguments, kernels on planes, missing cells, kept results."""

import math

import pytest

from gridloom.operators import warp as P


def grid(**kw):
    base = {"system": P.utm(33), "left": 500000.0, "top": 8700000.0, "res": (1000.0, 1000.0), "rows": 30, "cols": 20}
    return P.Grid(**base | kw)


def test_there_and_back_to_a_millimetre(spark):
    rows = [(9.0 + i * 0.37, 70.0 + j * 0.93) for i in range(33) for j in range(20)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    for system in (P.utm(33), P.POLAR):
        x, y = system.forward("lon", "lat")
        lon, lat = system.inverse("x", "y")
        got = df.selectExpr("lon", "lat", f"{x} AS x", f"{y} AS y").selectExpr("lon", "lat", f"{lon} AS lon2", f"{lat} AS lat2").collect()
        for r in got:
            off = 111_200 * math.hypot(r.lat - r.lat2, (r.lon - r.lon2) * math.cos(math.radians(r.lat)))
            assert off < 1e-3


def test_known_places(spark):
    """The zone's meridian at the equator, and the pole."""
    e, n = P.utm(33).forward("15.0", "0.0")
    x, y = P.POLAR.forward("-45.0", "90.0")
    r = spark.range(1).selectExpr(f"{e} AS e", f"{n} AS n", f"{x} AS x", f"{y} AS y").first()
    assert abs(r.e - 500000) < 1e-6 and abs(r.n) < 1e-6 and abs(r.x) < 1e-6 and abs(r.y) < 1e-6


def test_warped_bounds_hold_the_outline(spark):
    boxes = spark.createDataFrame([(1, 10.0, 78.0, 20.0, 80.0)], "k int, x0 double, y0 double, x1 double, y1 double")
    got = P.warp_bounds(boxes, ["k"], P.DEGREES, P.utm(33)).first()
    same = P.warp_bounds(boxes, ["k"], P.DEGREES, P.DEGREES).first()
    assert (same.x0, same.y0, same.x1, same.y1) == (10.0, 78.0, 20.0, 80.0)
    corners = spark.createDataFrame([(x, y) for x in (10.0, 20.0) for y in (78.0, 80.0)], "lon double, lat double")
    e, n = P.utm(33).forward("lon", "lat")
    for r in corners.selectExpr(f"{e} AS e", f"{n} AS n").collect():
        slack = 0.02 * (got.x1 - got.x0)  # corners may lie between two of the places
        assert got.x0 - slack <= r.e <= got.x1 + slack and got.y0 - slack <= r.n <= got.y1 + slack


def test_arguments_that_exclude_each_other(spark):
    t = (0.0, 0.0, 1.0, 1.0)
    for bad in ({"transform": t}, {"transform": t, "shape": (2, 2), "res": 1.0}, {"transform": t, "shape": (2, 2), "bounds": (0, 0, 1, 1)}, {"shape": (2, 2), "res": 1.0}):
        with pytest.raises(ValueError):
            P.target_grid(spark, grid(), **bad)
    assert P.target_grid(spark, grid(), transform=t, shape=(2, 3)) == grid(left=0.0, top=0.0, res=(1.0, 1.0), rows=2, cols=3)
    assert P.target_grid(spark, grid()) == grid()
    assert P.target_grid(spark, grid(), bounds=(0, 0, 10, 20), res=(3.0, 5.0)) == grid(left=0, top=20, res=(3.0, 5.0), rows=4, cols=4)
    auto = P.target_grid(spark, grid(), P.POLAR)
    assert 1000 < auto.res[0] < 1500 and auto.res[0] == auto.res[1]  # the diagonal keeps its cells


def test_names():
    assert [P.library_name(n) for n in ("nearest", "bilinear", "cubic", "cubic_spline", "average", "q1")] == ["NearestNeighbour", "Bilinear", "Cubic", "CubicSpline", "Average", "Q1"]
    with pytest.raises(KeyError):
        P.library_name("best")


@pytest.mark.parametrize("name", ["bilinear", "cubic", "cubic_spline", "lanczos"])
def test_kernels_keep_planes(spark, name):
    """A plane comes out as a plane (a constant for the kernel that isn't exact on slopes), to its edge, halves of cells apart."""
    cells = spark.createDataFrame([(r, c, (0.0 if name == "lanczos" else 2.0 * c - 3.0 * r) + 7) for r in range(30) for c in range(20)], "r int, c int, z double")
    target = grid(left=503250.0, top=8696250.0, res=(500.0, 500.0), rows=20, cols=20)
    for o in P.warp(cells, grid(), target, "z", name).collect():
        c, r = (target.left + (o.c + 0.5) * 500 - 500000) / 1000 - 0.5, (8700000 - target.top + (o.r + 0.5) * 500) / 1000 - 0.5
        assert abs(o.z - ((0.0 if name == "lanczos" else 2.0 * c - 3.0 * r) + 7)) < 1e-9


def test_missing_cells_and_outside(spark):
    cells = spark.createDataFrame([(r, c, -1.0 if (r, c) == (5, 5) else 10.0) for r in range(30) for c in range(20)], "r int, c int, z double")
    wide = grid(left=498000.0, rows=30, cols=24)
    for name in ("nearest", "bilinear", "cubic"):
        got = {(o.r, o.c): o.z for o in P.warp(cells, grid(), wide, "z", name, src_nodata=-1.0).collect()}
        assert len(got) == 720 and got[5, 7] == 0.0 and got[3, 0] == 0.0 and abs(got[5, 8] - 10) < 1e-9  # missing, outside, beside the gap
        none = {(o.r, o.c): o.z for o in P.warp(cells, grid(), wide, "z", name, -1.0, float("nan")).collect()}
        assert none[5, 7] is None and none[3, 0] is None
    low = {(o.r, o.c): o.z for o in P.warp(cells, grid(), grid(res=(5000.0, 5000.0), rows=6, cols=4), "z", "min").collect()}
    assert low[1, 1] == -1.0 and low[0, 0] == 10.0


def test_results_are_kept_by_their_arguments(spark):
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    assert [P.remembered(spark, "kept", [n, "a"], lambda n=n: make(n)).count() for n in (3, 3, 4)] == [3, 3, 4] and made == [3, 4]
    assert P.remembered(spark, "kept", [3, "a"], lambda: make(5), redo=True).count() == 5 and P.remembered(spark, "kept", [3, "a"], lambda: make(6)).count() == 5
    assert P.remembered(spark, "kept", ["3a"], lambda: make(7)).count() == 7
