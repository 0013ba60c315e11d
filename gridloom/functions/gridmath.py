"""Grid maths over columns: aligned bounds, shapes, resolutions, chunks and their names, checksums, model curves, name maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import col


def align(left, bottom, right, top, res: tuple[float, float], half: bool = False, buffer: float = 0.0) -> tuple[Column, ...]:
    """Bounds on multiples of the resolution, or half a step beside them: x edges go down to one, y edges up; then the buffer is added."""

    def down(x, step):
        shift = step / 2 if half else 0.0
        return F.floor((col(x) - shift) / step) * step + shift

    def up(y, step):
        shift = step / 2 if half else 0.0
        return F.ceil((col(y) - shift) / step) * step + shift

    return down(left, res[0]) - buffer, up(bottom, res[1]) - buffer, down(right, res[0]) + buffer, up(top, res[1]) + buffer


def shape(left, bottom, right, top, res: tuple[float, float]) -> tuple[Column, Column]:
    """(rows, columns), truncated."""
    return ((col(top) - col(bottom)) / res[1]).cast("int"), ((col(right) - col(left)) / res[0]).cast("int")


def resolution(left, bottom, right, top, rows, cols) -> tuple[Column, Column]:
    return (col(right) - col(left)) / col(cols), (col(top) - col(bottom)) / col(rows)


def pad(left, bottom, right, top, by) -> tuple[Column, ...]:
    return col(left) - by, col(bottom) - by, col(right) + by, col(top) + by


def window(left, bottom, right, top, x0: float, y1: float, res: float) -> tuple[Column, ...]:
    """(column, row, width, height) in whole pixels of a grid with its upper left corner at (x0, y1)."""
    return F.floor((col(left) - x0) / res).cast("int"), F.floor((y1 - col(top)) / res).cast("int"), F.rint((col(right) - col(left)) / res).cast("int"), F.rint((col(top) - col(bottom)) / res).cast("int")


def with_chunks(df: DataFrame, res: float, size: int) -> DataFrame:
    """A row per chunk of the bounds (x0, y0, x1, y1): its number ``i`` (row by row), place and bounds; the last are cut."""
    rows, cols = shape("x0", "y0", "x1", "y1", (res, res))
    many = lambda n: F.ceil(n / float(size)).cast("int")
    each = df.withColumn("rows", rows).withColumn("cols", cols).withColumn("down", many(F.col("rows"))).withColumn("across", many(F.col("cols")))
    each = each.where("down > 0 and across > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("down") * F.col("across") - 1)))
    each = each.withColumn("col", F.col("i") % F.col("across")).withColumn("row", ((F.col("i") - F.col("col")) / F.col("across")).cast("int"))
    edge = lambda at, n: F.least((F.col(at) + 1) * size, F.col(n))
    bounds = {
        "left": F.col("x0") + F.col("col") * size * res, "right": F.col("x0") + edge("col", "cols") * res,
        "top": F.col("y1") - F.col("row") * size * res, "bottom": F.col("y1") - edge("row", "rows") * res,
    }
    return each.withColumns(bounds)


def chunk_name(row, column, down, across) -> Column:
    """chunk_<row>_<column> with one digit more than the greater number of chunks needs."""
    digits = (F.ceil(F.log10(F.greatest(col(down), col(across)).cast("double"))) + 1).cast("int")
    return F.concat_ws("_", F.lit("chunk"), F.lpad(col(row).cast("string"), digits, F.lit("0")), F.lpad(col(column).cast("string"), digits, F.lit("0")))


def checksum(*parts) -> Column:
    return F.sha2(F.concat(*(col(p).cast("string") for p in parts)), 256)


def peak_with_tail(x, height: float, centre: float, width: float, slope: float, offset: float, steep: float, switch: float) -> Column:
    """A Gaussian peak that goes over into a line by a logistic weight around ``switch``."""
    x = col(x)
    weight = 1 / (1 + F.exp(steep * (x - switch)))
    z = (x - centre) / width
    return weight * height * F.exp(z * z / -2) + (1 - weight) * (slope * x + offset)


def taylor_shift(coefficients, by) -> Column:
    """Coefficients (lowest degree first) of p(x + by): repeated synthetic division, one fold per degree."""
    c = col(coefficients)

    def step(acc, k):
        """From the top down to degree k each coefficient gets ``by`` times the one above."""
        top = F.size(acc) - 1
        down = F.sequence(top, k, F.lit(-1))
        folded = F.aggregate(F.slice(down, 2, F.size(down)), F.array(F.element_at(acc, -1)), lambda a, i: F.concat(F.array(F.element_at(acc, i + 1) + col(by) * a[0]), a))
        return F.when(k > 0, F.concat(F.slice(acc, 1, F.greatest(k, F.lit(1))), folded)).otherwise(folded)

    return F.when(F.size(c) > 1, F.aggregate(F.sequence(F.lit(0), F.size(c) - 2), c, step)).otherwise(c)


def error_name(name) -> Column:
    """The name of a variable's error: slope to se, accel to accel_se."""
    return F.replace(F.replace(col(name), F.lit("_slope"), F.lit("_se")), F.lit("_accel"), F.lit("_accel_se"))


#: Regions by name as (left, bottom, right, top).
REGIONS = {"BUILDING": (0.0, 0.0, 20.0, 25.0), "MACHINERY": (10.0, 0.0, 40.0, 30.0), "FURNITURE": (0.0, 10.0, 30.0, 60.0)}
