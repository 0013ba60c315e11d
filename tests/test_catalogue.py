"""Queries against their SQL in DuckDB, and column expressions against hand-computed values."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gridloom import catalogue
from gridloom.functions import columns as C
from gridloom.operators import grid as G

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    one = lambda x: x if x is None or isinstance(x, (str, bool)) else round(float(x), 6)
    return list(df.columns), sorted((tuple(one(x) for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_oracle(spark, sf, oracle, name):
    assert rows(catalogue.QUERIES[name](spark, sf).toPandas()) == rows(oracle.execute(catalogue.ORACLE[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["r", "c", "yr", "median", "nmad", "n", "day_code"]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_codecs(spark):
    f = lambda v: F.lit(v).cast("double")
    got = one(spark, *(C.encode_unsigned(f(v), 1500) for v in (750.0, 1500.0, 100.0, -5.0, None)), C.encode_signed(f(1.0), 50), C.encode_signed(f(-50.0), 50), C.encode_signed(f(None), 50), *(C.encode_correlation(f(v)) for v in (-1.0, 1.0, None)))
    assert tuple(got) == (32767, 65534, 4368, 0, 65535, 655, -32766, -32768, 0, 254, 255)
    assert one(spark, C.hypot_raw(F.lit(3), F.lit(4)), C.hypot_raw(F.lit(65535), F.lit(4)), C.hypot_raw(F.lit(65534), F.lit(65534)))[:] == (5, 65535, 65534)


def test_expressions(spark):
    got = one(spark, *(C.digitise(F.lit(v), [0, 2, 5]) for v in (-1, 0, 2, 5)), C.blend(F.lit(10.0), F.lit(20.0), F.lit(0.25)), C.blend(F.lit(10.0), F.lit(None).cast("double"), F.lit(0.25)), C.day_code(F.lit("2016-06-10").cast("date")))
    assert tuple(got) == (0, 1, 2, 3, 12.5, 10.0, 190)
    d = one(spark, C.derivative(F.array(*(F.lit(float(x)) for x in (5, 4, 3, 2)))).alias("d")).d
    assert d == [0.0, 15.0, 8.0, 3.0]


def test_robust_stack(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0), (1, None), (2, None)], "k int, v double")
    got = {r.k: (r.median, r.nmad, r.n) for r in G.robust_stack(df, ["k"], "v").collect()}
    assert got[1] == (2.0, pytest.approx(1.4826), 3) and got[2] == (None, None, 0)


def test_linear_trend(spark):
    data = [(1, 0.0, 1.0), (1, 1.0, 3.0), (1, 2.0, None), (1, 3.0, 7.0), (2, 0.0, 1.0), (2, 1.0, 1.0), (3, 0.0, 5.0)]
    got = {r.k: r for r in G.linear_trend(spark.createDataFrame(data, "k int, t double, y double"), ["k"], "t", "y").collect()}
    assert (got[1].n, got[1].slope, got[1].intercept, got[1].corr) == (3, pytest.approx(2), pytest.approx(1), pytest.approx(1))
    assert math.isclose(got[1].sxx, 14 / 3) and (got[2].slope, got[2].corr) == (0.0, 0.0) and got[3].slope is None


def test_bootstrap_draws_from_every_year(spark, sf):
    """Every year has its 50 resamples."""
    assert {r.n for r in catalogue.QUERIES["a11_bootstrap_whole"](spark, sf).collect()} == {50}


def test_asof_reads_every_event(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    assert catalogue.QUERIES["j12_asof_all"](spark, sf).count() == events


def test_brackets_of_every_event(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    assert catalogue.QUERIES["w08_bracket_all"](spark, sf).count() == events


def test_replicates_have_all_pairs(spark, sf):
    m = min(500, spark.read.parquet(f"{sf}/customer.parquet").count())
    pairs = catalogue.QUERIES["j16_replicate_pairs"](spark, sf).collect()
    assert len(pairs) == 100 and {r.n for r in pairs} == {m * (m - 1) // 2}


def test_priority_mosaic_by_hand(spark):
    """p75 with an NMAD of 12 fails its gate, p95 with one of 20 passes; a tile with the first source takes neither; counts gate the last."""
    from gridloom.plans.products import prioritised

    def three(r, yr, dem, mid, nmad):
        return [(r, 0, yr, dem, 20 * (mid + k * nmad / 1.4826)) for k in (-1, 0, 1)]

    rows = three(0, 1996, 1, 99.0, 12) + three(0, 1996, 2, 101.0, 20)  # p75, p95
    rows += three(16, 1996, 2, 50.0, 1) + three(17, 1996, 0, 60.0, 2)  # the tile of r 16 and 17 has vertcoreg
    rows += three(32, 1997, 3, 70.0, 5) + [(33, 0, 1997, 3, 20 * 80.0)]  # uncorr: bias of a year is (yr - 1995) / 2; one observation is too few
    got = {r.r: (r.z, r.quality) for r in prioritised(spark.createDataFrame(rows, "r int, c int, yr int, dem_id long, z double")).collect()}
    assert got[0] == (pytest.approx(101), 2) and got[16] == (None, 0) and got[17] == (pytest.approx(60), 4) and got[32] == (pytest.approx(71), 3) and got[33] == (None, 0)


def test_robust_trend_stops_when_good(spark):
    """The first year whose omission brings the NMAD to the limit wins, later better ones aren't tried."""
    from gridloom.plans import trends

    rows = [(0, 0, 1993 + t, 100.0 * z) for t, z in enumerate((0, 9, 2, 3, 4, 5, 6))]
    got = trends.r02_robust_trend(spark.createDataFrame(rows, "r int, c int, yr int, z double")).first()
    fits = {}
    import numpy as np

    t, z = np.arange(7.0), np.array((0, 9, 2, 3, 4, 5, 6.0))
    for o in (None, *range(7)):
        k = np.ones(7, bool) if o is None else np.arange(7) != o
        e = z[k] - np.polyval(np.polyfit(t[k], z[k], 1), t[k])
        fits[o] = round(1.4826 * float(np.median(np.abs(e - np.median(e)))), 6)
    cur, left = fits[None], None
    for o in range(7):
        if cur > 1.5 and fits[o] < cur:
            cur, left = fits[o], o
    assert (got.left_out, got.nmad) == (None if left is None else left - 2, pytest.approx(cur, abs=1e-5))


def test_grid_maths_examples(spark):
    from gridloom.functions import gridmath as M

    d = lambda *x: [F.lit(float(v)) for v in x]
    bounds = d(0, -0.3, 11, 10)
    assert tuple(one(spark, *M.align(*bounds, (10.0, 10.0)))) == (0, 0, 10, 10)
    assert tuple(one(spark, *M.align(*bounds, (10.0, 10.0), half=True))) == (-5, 5, 5, 15)
    assert tuple(one(spark, *M.align(*bounds, (10.0, 10.0), half=True, buffer=10.0))) == (-15, -5, 15, 25)
    assert tuple(one(spark, *M.shape(*d(0, 0, 10, 10), (1.0, 10.0)))) == (1, 10) and tuple(one(spark, *M.resolution(*d(0, 0, 10, 10), *d(1, 10)))) == (1, 10)
    box = spark.createDataFrame([(0.0, 0.0, 500.0, 1000.0)], "x0 double, y0 double, x1 double, y1 double")
    cols = ("left", "bottom", "right", "top")
    chunks = lambda size: [tuple(r[c] for c in cols) for r in M.with_chunks(box, 10.0, size).orderBy("i").collect()]
    assert chunks(50) == [(0, 500, 500, 1000), (0, 0, 500, 500)] and chunks(100) == [(0, 0, 500, 1000)]
    assert one(spark, M.chunk_name(F.lit(3), F.lit(22), F.lit(30), F.lit(32)).alias("n")).n == "chunk_003_022"
    shifted = one(spark, M.taylor_shift(F.array(*d(1, 2, 3, 4)), F.lit(2.0)).alias("p")).p
    assert shifted == [49, 62, 27, 4] and one(spark, M.taylor_shift(F.array(*d(7)), F.lit(2.0)).alias("p")).p == [7]


def test_decimal_year_and_codes(spark):
    day = F.lit("2016-06-10").cast("date")
    year = one(spark, C.decimal_year(day).alias("y")).y
    assert year == pytest.approx(2016.527778, abs=1e-6) and year - (2009 + 8 / 12) == pytest.approx(6.861111, abs=1e-6)
    assert tuple(one(spark, C.sum_raw(F.lit(3), F.lit(4)), C.sum_raw(F.lit(3), F.lit(-32768)))) == (7, -32768)
    open_, closed = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 2.0, 1.0)], "ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double").select(C.overlap_open("a", "b"), C.overlap_closed("a", "b")).first()
    assert (open_, closed) == (False, True)


def test_quantiles_of_ties_and_null_keys(spark):
    import numpy as np

    from gridloom.operators.quantiles import exact_nmad, exact_quantiles

    rng = np.random.default_rng(4)
    rows = [(k, None if i % 50 == 0 else float(v)) for k in (None, 1, 2) for i, v in enumerate(np.round(rng.standard_cauchy(700), 1))] + [(3, 5.0)] * 40 + [(4, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"low": 0.01, "mid": 0.5, "top": 1.0}, buckets=16).collect()}
    spread = {r.k: r for r in exact_nmad(df, ["k"], "v").collect()}
    for k in (None, 1, 2, 3):
        v = np.array([x for g, x in rows if g == k and x is not None])
        assert [got[k].low, got[k].mid, got[k].top] == pytest.approx(np.quantile(v, [0.01, 0.5, 1.0]).tolist()) and got[k].n == len(v)
        assert spread[k].nmad == pytest.approx(1.4826 * np.median(np.abs(v - np.median(v))))
    assert 4 not in got and exact_quantiles(df.limit(0), ["k"], "v", {"mid": 0.5}).count() == 0


def test_surfaces_by_brute_force(spark):
    import numpy as np

    from gridloom.operators import surface as S

    rng = np.random.default_rng(2)
    mask = rng.random((17, 23)) < 0.04
    cells = spark.createDataFrame([(i, j, bool(mask[i, j])) for i in range(17) for j in range(23)], "r int, c int, m boolean")
    got = {(r.r, r.c): r.d for r in S.distance_transform(cells, F.col("m")).collect()}
    at = np.argwhere(mask)
    assert all(d == pytest.approx(np.sqrt(((at - k) ** 2).sum(1)).min()) for k, d in got.items()) and len(got) == 17 * 23
    assert {r.d for r in S.distance_transform(cells, F.lit(False)).collect()} == {None}
    east, north = S.utm_text("lon", "lat", 15.0)
    x, y = spark.sql(f"select {east} as e, {north} as n from values (cast(15 as double), cast(0 as double)), (cast(16 as double), cast(78.25 as double)) t(lon, lat)").collect()
    # on the zone's meridian the northing is the scaled arc; beside it the easting is a short arc of the parallel
    e2, phi = S.FLAT * (2 - S.FLAT), np.radians(78.25)
    fine = np.linspace(0, phi, 200_001)
    curve = S.AXIS * (1 - e2) / (1 - e2 * np.sin(fine) ** 2) ** 1.5
    arc = S.SCALE * ((curve[1:] + curve[:-1]) / 2 * np.diff(fine)).sum()
    nu, step = S.AXIS / np.sqrt(1 - e2 * np.sin(phi) ** 2), np.radians(1) * np.cos(phi)
    k = e2 / (1 - e2) * np.cos(phi) ** 2
    assert (x.e, x.n) == (pytest.approx(500000), pytest.approx(0)) and y.e == pytest.approx(500000 + S.SCALE * nu * (step + (1 - np.tan(phi) ** 2 + k) * step**3 / 6), abs=0.01)
    assert y.n == pytest.approx(arc + S.SCALE * nu * np.tan(phi) * step**2 / 2, abs=0.01)
    px, py = S.polar_text("lon", "lat")
    q = spark.sql(f"select {px} as x, {py} as y from values (cast(-45 as double), cast(70 as double)) t(lon, lat)").first()
    # on the parallel of true scale the circle's radius is that of the ellipsoid's parallel there
    m = S.AXIS * np.cos(np.radians(70)) / np.sqrt(1 - e2 * np.sin(np.radians(70)) ** 2)
    assert q.x == pytest.approx(0, abs=1e-6) and q.y == pytest.approx(-m, abs=1e-3)


def test_solvers_find_what_was_planted(spark):
    import numpy as np

    from gridloom.operators import solvers as V

    x = np.linspace(0, 10, 60)
    y = 3 + 2 * x
    y[::10] += 100
    assert V.huber_fit(np.column_stack([np.ones(60), x]), y) == pytest.approx([3, 2], abs=0.2)
    lags = np.arange(1, 40.0)
    model = np.where(lags < 20, 2 + 5 * (1.5 * lags / 20 - 0.5 * (lags / 20) ** 3), 7)
    assert V.fit_spherical(lags.tolist(), model.tolist(), [1.0] * 39) == pytest.approx((2, 5, 20), rel=0.03)
    blocks = spark.createDataFrame([(0, float(i % 6), float(i // 6), float(i % 5), 7 + 3.0 * (i % 6) + 4.0 * (i % 5)) for i in range(90)], "k int, x double, y double, t double, z double")
    assert V.block_polynomials(blocks, ["k"], limit=10.0).first().n == 90


def test_stream_takes_each_file_once(spark, tmp_path):
    from gridloom.streaming import tiles

    source, schema = str(tmp_path / "in"), "r int, c int, yr int, z double"
    args = (source, schema, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "check"), spark)
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    write([(0, 0, 2000, 1.0), (9, 0, 2000, 5.0)])
    assert {(r.r, r.z, r.n) for r in tiles.refresh(*args).collect()} == {(0, 1.0, 1), (9, 5.0, 1)}
    write([(0, 0, 2000, 3.0)])
    assert {(r.r, r.z, r.n) for r in tiles.refresh(*args).collect()} == {(0, 2.0, 2), (9, 5.0, 1)}
    assert {(r.r, r.z, r.n) for r in tiles.refresh(*args).collect()} == {(0, 2.0, 2), (9, 5.0, 1)}
