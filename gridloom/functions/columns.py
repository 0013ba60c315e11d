"""Column expressions: robust statistics, codecs, dates, binning. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NMAD_SCALE = 1.4826


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x, low: float, high: float) -> Column:
    """Held to [low, high]; null stays null (Spark's least and greatest skip nulls)."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def null_if_sentinel(x, *sentinels: float) -> Column:
    """NaN and sentinel values to null, so that neither reaches an aggregate."""
    x = col(x)
    return F.when(~F.isnan(x) & ~x.isin(*sentinels), x)


def day_code(d) -> Column:
    """month * 30 + day (not the day of the year)."""
    return F.month(col(d)) * 30 + F.dayofmonth(col(d))


def decimal_year(d) -> Column:
    d = col(d)
    return F.year(d).cast("double") + F.month(d).cast("double") / 12 + F.dayofmonth(d).cast("double") / 360


def plane(x, y, a, b, c, cx, cy) -> Column:
    return col(a) * (col(x) - col(cx)) + col(b) * (col(y) - col(cy)) + col(c)


def digitise(x, edges: list[float]) -> Column:
    """The number of edges at or below x: bin i holds edges[i-1] <= x < edges[i]."""
    x = col(x)
    total = sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(x.isNotNull(), total)


def uniform_bin(x, low: float, width: float) -> Column:
    return (F.floor((col(x) - low) / width)).cast("int")


#: Fixed values of the storage codecs: raw steps, largest raw value and nodata of each kind.
DEM_MAX, NMAD_MAX, SE_MAX, SLOPE_MAX, ACCEL_MAX = 1500, 100, 10, 50, 20
U16, U16_NODATA, I16, I16_NODATA, U8, U8_NODATA = 65534, 65535, 32766, -32768, 254, 255


def encode_unsigned(x, vmax: float) -> Column:
    """To 0..65534 in single precision, truncated; null to 65535."""
    raw = col(x).cast("float") * F.lit(U16 / vmax).cast("float")
    return F.when(col(x).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(float(U16)), raw.cast("double"))).cast("int")).otherwise(U16_NODATA)


def decode_unsigned(raw, vmax: float) -> Column:
    return F.when(col(raw) != U16_NODATA, col(raw).cast("double") * vmax / U16)


def encode_signed(x, vmax: float) -> Column:
    v = F.greatest(F.lit(-32767.0), F.least(F.lit(32766.0), col(x) * I16 / vmax))
    return F.when(col(x).isNotNull(), v.cast("int")).otherwise(I16_NODATA)


def decode_signed(raw, vmax: float) -> Column:
    return F.when(col(raw) != I16_NODATA, col(raw).cast("double") * vmax / I16)


def encode_correlation(r) -> Column:
    v = F.greatest(F.lit(0.0), F.least(F.lit(254.0), (col(r) + 1) * 127))
    return F.when(col(r).isNotNull(), v.cast("int")).otherwise(U8_NODATA)


def decode_correlation(raw) -> Column:
    return F.when(col(raw) != U8_NODATA, col(raw).cast("double") * 2 / U8 - 1)


def hypot_raw(a, b) -> Column:
    """Half-even rounded root of squares in the raw domain; nodata if either is."""
    a, b = col(a), col(b)
    x, y = a.cast("double"), b.cast("double")
    v = F.rint(F.sqrt(x * x + y * y))
    return F.when((a != U16_NODATA) & (b != U16_NODATA), F.least(F.lit(float(U16)), v).cast("int")).otherwise(U16_NODATA)


def sum_raw(a, b) -> Column:
    return F.when((col(a) != I16_NODATA) & (col(b) != I16_NODATA), col(a) + col(b)).otherwise(I16_NODATA)


def blend(a, b, weight) -> Column:
    """weight * b + (1 - weight) * a where both are there, else whichever is."""
    a, b, w = col(a), col(b), col(weight)
    return F.when(a.isNotNull() & b.isNotNull(), w * b + (1 - w) * a).otherwise(F.coalesce(a, b))


def polynomial(coefficients, x) -> Column:
    """Horner's rule over an array of coefficients, the highest degree first."""
    return F.aggregate(col(coefficients), F.lit(0.0), lambda acc, c: acc * col(x) + c)


def derivative(coefficients) -> Column:
    """Coefficients (highest degree first) of the first derivative, the same length, padded in front."""
    n = F.size(coefficients)
    scaled = F.transform(F.slice(coefficients, 1, n - 1), lambda c, i: c * (n - 1 - i))
    return F.concat(F.array(F.lit(0.0)), scaled)


def in_ring(x, y, ring) -> Column:
    """Even-odd test of a point against an array of vertices struct<x, y> (closed by itself)."""
    x, y, ring = col(x), col(y), col(ring)
    n = F.size(ring)

    def step(acc, i):
        p, q = F.element_at(ring, i + 1), F.element_at(ring, (i + 1) % n + 1)
        crosses = ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]) + p["x"])
        return F.when(F.coalesce(crosses, F.lit(False)), ~acc).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), step)


def overlap_open(a: str, b: str) -> Column:
    """Rectangles that share more than their rim; columns <p>x0, <p>y0, <p>x1, <p>y1."""
    return (F.col(a + "x0") < F.col(b + "x1")) & (F.col(a + "x1") > F.col(b + "x0")) & (F.col(a + "y0") < F.col(b + "y1")) & (F.col(a + "y1") > F.col(b + "y0"))


def overlap_closed(a: str, b: str) -> Column:
    return (F.col(a + "x0") <= F.col(b + "x1")) & (F.col(a + "x1") >= F.col(b + "x0")) & (F.col(a + "y0") <= F.col(b + "y1")) & (F.col(a + "y1") >= F.col(b + "y0"))
