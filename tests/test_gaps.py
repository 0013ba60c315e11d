"""Gap experiments, polynomials, long curves and numbering by ranges, against plain NumPy and planted cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import gaps
from gridloom.operators import grid as G
from gridloom.operators import solvers as V
from gridloom.operators.trends import polynomial_fit, robust_trend
from gridloom.plans import joins


def test_layout_of_gaps_by_hand():
    # room 18; 5 fit along an axis, 20 are wanted: 5 x 4 and 4 x 5 are as square, more rows win
    assert gaps.gap_starts(20, 2, 1, 2, 2, 20, 4) == ([1, 5, 9, 13, 17], [1, 6, 12, 17])
    # a quarter of the count of 2 would be 5; 2 x 2 are the most that fit at 5 cells
    assert gaps.gap_starts(20, 5, 1, 2, 2, 20, 4) == ([1, 14], [1, 14])
    # one gap in the middle
    assert gaps.gap_starts(20, 12, 1, 2, 2, 20, 4) == ([4], [4])
    for size, edge, inner in ((19, 1, 2), (2, 0, 2), (2, 1, 0)):
        with pytest.raises(ValueError):
            gaps.gap_starts(20, size, edge, inner, 2, 20, 4)


@pytest.fixture(scope="module")
def field(spark):
    """Two chunks by two: the trend, and one without the last year that is off by a slanted plane; a corner is off the ice."""
    rng = np.random.default_rng(5)
    r, c = np.mgrid[0:40, 0:40]
    b = rng.normal(0, 0.01, r.shape)
    w = b + 0.1 + 0.004 * r - 0.002 * c + rng.normal(0, 0.002, r.shape)
    ice = ~((r < 6) & (c < 6))
    rows = [(int(i), int(j), float(b[i, j]), float(w[i, j]), 0.1, bool(ice[i, j])) for i in range(40) for j in range(40)]
    df = spark.createDataFrame(rows, "r int, c int, b double, w double, nmad double, ice boolean").repartition(4)
    return b, w, ice, df


def test_gap_cells_and_distances(field):
    layouts = {s: gaps.gap_starts(20, s, 1, 2, 2, 20, 4) for s in (2, 5)}
    got = gaps.gap_cells(field[3].select("r", "c"), layouts, 20).collect()
    for size, (rows, cols) in layouts.items():
        mask = np.zeros((20, 20), bool)
        for a in rows:
            for b in cols:
                assert not mask[a - 1 : a + size + 1, b - 1 : b + size + 1].any()
                mask[a : a + size, b : b + size] = True
        mask = np.tile(mask, (2, 2))
        outside = np.argwhere(~mask)
        mine = {(x.r, x.c): x for x in got if x.size == size}
        assert set(mine) == {tuple(p) for p in np.argwhere(mask).tolist()}
        for (r, c), x in mine.items():
            assert x.d == pytest.approx(np.sqrt(((outside - (r, c)) ** 2).sum(1).min()))
            assert x.gr <= r < x.gr + size and x.gc <= c < x.gc + size


def test_gaps_are_corrected_across_their_edges(field):
    b, w, ice, df = field
    layouts = {s: gaps.gap_starts(20, s, 1, 2, 2, 20, 4) for s in (3, 6)}
    got = gaps.gap_errors(df, layouts, 20).collect()
    assert len(got) == gaps.gap_cells(df, layouts, 20).count()
    for x in got:
        assert x.raw == pytest.approx(w[x.r, x.c] - b[x.r, x.c])
        if not ice[x.r, x.c]:
            assert x.diff == x.raw
    on = [x for x in got if ice[x.r, x.c]]
    raw, diff = np.array([x.raw for x in on]), np.array([x.diff for x in on])
    assert np.abs(raw).mean() > 0.1 and np.abs(diff).mean() < 0.02
    means = {s: {} for s in layouts}
    for x in got:
        means[x.size].setdefault((x.gr, x.gc), []).append(x.diff)
    frame = df.sparkSession.createDataFrame(got)
    spread = lambda v: 1.4826 * np.median(np.abs(np.array(v) - np.median(v)))
    for x in gaps.area_curve(frame).collect():
        m = [np.mean(v) for v in means[x.size].values()]
        assert (x.n, x.area) == (len(m), x.size**2) and x.nmad == pytest.approx(spread(m))
    width = (3 + 0.02) / 49
    for x in gaps.distance_curve(frame).collect():
        v = [y.diff for y in got if int((y.d + 0.01) // width) == x.bin]
        assert x.n == len(v) and x.nmad == pytest.approx(spread(v)) and abs(x.distance - (x.bin + 0.5) * width + 0.01) < 1e-9


def test_gaps_without_pairs_have_no_correction(field):
    """Differences over the gate, missing trends and an empty table."""
    far = field[3].withColumn("w", F.when(F.col("r") == 2, F.lit(None)).otherwise(F.col("b") + 5).cast("double"))
    got = gaps.gap_errors(far, {3: gaps.gap_starts(20, 3, 1, 2, 2, 20, 4)}, 20)
    assert got.where("diff is not null").select("r", "c").join(field[3].where("ice"), ["r", "c"]).count() == 0
    none = gaps.gap_errors(far.limit(0), {3: gaps.gap_starts(20, 3, 1, 2, 2, 20, 4)}, 20)
    assert none.count() == 0 and gaps.area_curve(none).count() == 0 and gaps.distance_curve(none).count() == 0


def test_polynomials_from_sums(spark):
    rng = np.random.default_rng(2)
    series = {k: (np.sort(rng.choice(np.arange(-6, 7), m, replace=False)).astype(float), rng.normal(0, 9, m)) for k, m in enumerate((1, 2, 3, 4, 7, 13))}
    series[9] = (np.array([1.0, 1.0, 2.0]), np.array([3.0, 5.0, 10.0]))  # a value of t twice
    rows = [(k, float(a), float(b)) for k, (t, y) in series.items() for a, b in zip(t, y, strict=True)] + [(0, None, 4.0), (0, 3.0, None)]
    got = {r.k: r for r in polynomial_fit(spark.createDataFrame(rows, "k int, t double, y double"), ["k"], "t", "y", 3, scale=6.0).collect()}
    assert set(got) == set(series)
    for k, (t, y) in series.items():
        degree = min(3, len(set(t)) - 1)
        want = np.polyfit(t, y, degree)[::-1]
        assert got[k].n == len(t) and got[k].coefficients == pytest.approx([*want, *[0.0] * (3 - degree)], abs=1e-7)


def test_robust_trend_leaves_a_year_out(spark):
    """One year far off in eight; a flat series; one value."""
    y = [2.0 * t for t in range(8)]
    y[7] += 60
    rows = [(0, t, v) for t, v in enumerate(y)] + [(1, t, 5.0) for t in range(3)] + [(2, 0, 1.0), (2, 1, None)]
    got = {r.k: r for r in robust_trend(spark.createDataFrame(rows, "k int, t int, y double"), ["k"], "t", "y", 1.5).collect()}
    assert set(got) == {0, 1} and (got[0].left_out, got[0].nmad) == (7, 0) and got[0].slope == pytest.approx(2) and got[0].intercept == pytest.approx(0)
    assert (got[1].left_out, got[1].slope, got[1].intercept) == (None, 0.0, 5.0)


def test_block_polynomials_find_what_is_planted(spark):
    """A plane and a parabola over time, with a tenth of the values far off; a block with too few values; one with none."""
    rng = np.random.default_rng(4)
    rows = [(0, float(x), float(y), float(t), 0.5 * (x - 3.5) - 0.25 * (y - 3.5) + 2.0 * t - 0.5 * t * t + float(rng.normal(0, 0.01))) for x in range(8) for y in range(8) for t in range(-3, 4) if t]
    rows = [(*r[:4], r[4] + (50.0 if i % 10 == 0 else 0.0)) for i, r in enumerate(rows)]
    rows += [(1, 0.0, 0.0, 1.0, 2.0), (2, 0.0, 0.0, 1.0, None)]
    got = V.block_polynomials(spark.createDataFrame(rows, "k int, x double, y double, t double, z double"), ["k"], (1, 2), limit=0.1, origin=2000.0).collect()
    by = {(r.k, r.degree): r for r in got}
    assert len(by) == 6 and all(by[k, d].coefficients is None for k in (1, 2) for d in (1, 2)) and (by[1, 1].n, by[2, 1].n) == (1, 0)
    r = by[0, 2]
    assert r.n == 384 and r.n_in == 384 - 39 and r.score > 0.999 and r.slope_x == pytest.approx(0.5, abs=0.01) and r.slope_y == pytest.approx(-0.25, abs=0.01)
    at = lambda t: sum(c * (2000.0 + t) ** i for i, c in enumerate(r.coefficients))
    for t in (-3, -1, 2):
        assert at(t) == pytest.approx(2.0 * t - 0.5 * t * t, abs=0.05)
    assert by[0, 1].score < 0.99 and len(by[0, 1].coefficients) == 3


def test_long_curves_are_cut_into_bins(spark):
    """Clustered points of a curve, places between, on, before and beyond them; the same as the broadcast way."""
    rng = np.random.default_rng(6)
    cx = np.unique(np.concatenate([rng.random(300), rng.random(60) * 50, [100.0]]))
    cy = np.cumsum(rng.normal(0, 1, len(cx)))
    x = np.concatenate([rng.random(200) * 110 - 5, cx[::7], [cx[0], cx[-1], -3.0, 120.0]])
    curve = spark.createDataFrame([*zip(cx.tolist(), cy.tolist(), strict=True), (None, 1.0)], "a double, b double").repartition(5)
    at = spark.createDataFrame([*enumerate(x.tolist()), (-1, None)], "i int, x double").repartition(3)
    got = {r.i: r.y for r in G.lerp_lookup(at, curve, "x", "a", "b", "y", rows=50).collect()}
    short = {r.i: r.y for r in G.lerp_lookup(at, curve, "x", "a", "b", "y").collect()}
    assert set(got) == set(short) == set(range(len(x)))
    k = np.clip(np.searchsorted(cx, x, side="right") - 1, 0, len(cx) - 2)
    want = cy[k] + (x - cx[k]) / (cx[k + 1] - cx[k]) * (cy[k + 1] - cy[k])
    assert [got[i] for i in range(len(x))] == pytest.approx(want.tolist(), rel=1e-9, abs=1e-9) and [short[i] for i in range(len(x))] == pytest.approx(want.tolist(), rel=1e-9, abs=1e-9)


def test_numbers_within_an_hour_by_ranges(spark, monkeypatch):
    """One hour of one track with nearly all rows: no range has more rows than it has ids."""
    monkeypatch.setattr(joins, "ID_RANGE", 7)
    rows = [(i * 3 % 101, "a" if i % 9 else "b", 1_000 + i % 5) for i in range(101)]
    df = spark.createDataFrame(rows, "event_id long, track string, s long").select("event_id", "track", F.timestamp_seconds("s").alias("ts"))
    got = {r.event_id: r.t for r in joins.w10_time_dedup(df).collect()}
    for track in "ab":
        ids = sorted(i for i, k, _ in rows if k == track)
        assert [got[i] for i in ids] == list(range(len(ids)))


def test_robust_trends_gather_series_once(spark):
    """Lines and refits come from one shuffle; series of many lengths, flat ones and such without a line."""
    rng = np.random.default_rng(2)
    rows = [(k, t, float(rng.normal() * 3 + t)) for k in range(60) for t in rng.choice(12, k % 9, replace=False).tolist()]
    rows += [(100, t, 7.0) for t in range(5)] + [(101, 3, 1.0), (101, 4, None), (102, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, t int, y double")
    out = robust_trend(df, ["k"], "t", "y", 1.5)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1
    spread = lambda e: 1.4826 * np.median(np.abs(e - np.median(e)))

    def line(s):
        t, y = np.array([a for a, _ in s], float), np.array([b for _, b in s])
        b = ((t - t.mean()) * (y - y.mean())).sum() / ((t - t.mean()) ** 2).sum()
        return round(spread(y - b * t - (y.mean() - b * t.mean())), 6), b

    got, n = {r.k: r for r in out.collect()}, 0
    for k in {r[0] for r in rows}:
        s = sorted((t, y) for i, t, y in rows if i == k and t is not None and y is not None)
        if len(s) < 2:
            assert k not in got
            continue
        best = (None, *line(s))
        for o, _ in s if len(s) > 2 else ():
            nmad, slope = line([x for x in s if x[0] != o])
            if best[1] > 1.5 and nmad < best[1]:
                best = (o, nmad, slope)
        n += best[0] is not None
        assert got[k].left_out == best[0] and (got[k].nmad, got[k].slope) == pytest.approx(best[1:], abs=2e-6)
    assert n > 5
