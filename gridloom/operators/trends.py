"""Trends of short series, all cells at once: robust lines, and polynomials from sums of powers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import NMAD_SCALE

#: Values of series that are fitted together at most, unless one is longer.
ROWS = 1 << 20


def line_fits(t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(NMAD of the residuals, slope, intercept) of the line through every row of ``t`` and ``y``; NaN where there is none, slope 0 if y is flat."""
    if t.shape[1] < 2:
        return (np.full(len(t), np.nan),) * 3
    mt, my = t.mean(1), y.mean(1)
    dt, dy = t - mt[:, None], y - my[:, None]
    sxx = (dt * dt).sum(1)
    slope = np.where((dy * dy).sum(1) <= 1e-12, 0.0, (dt * dy).sum(1) / np.where(sxx > 0, sxx, np.nan))
    slope[~(sxx > 0)] = np.nan
    intercept = my - slope * mt
    e = y - slope[:, None] * t - intercept[:, None]
    return NMAD_SCALE * np.median(np.abs(e - np.median(e, 1)[:, None]), 1), slope, intercept


def robust_trend(series: DataFrame, keys: list[str], t: str, y: str, rough: float) -> DataFrame:
    """keys, left_out, nmad, slope, intercept: a line by key, and year by year, while the residuals' NMAD is over ``rough``, the refit
    without that year if its NMAD is less. Keys with under two values have no row; a key has a value per ``t``.

    NMADs are compared at 6 decimals. A key gathers its few years once; lines of all keys with as many years are fitted together,
    those without a year only where the line is rough. Refits are folded in the order of years.
    """
    place = F.struct(F.col(t).alias("t"), F.col(y).cast("double").alias("y"))
    kept = series.where(F.col(t).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(place)).alias("_s")).where(F.size("_s") >= 2)

    def lines(times: pd.Series, values: pd.Series) -> pd.DataFrame:
        sizes = values.map(len).to_numpy()
        out = np.empty((len(sizes), 3), object)
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            for at in np.array_split(rows, max(1, len(rows) * n // ROWS)):
                x, v = (np.stack(c.iloc[at].to_list()).astype(float) for c in (times, values))
                first = line_fits(x, v)
                again = first[0] > rough - 1e-6
                fits = [np.full((len(at), n + 1), np.nan) for _ in first]
                for f, a in zip(fits, first, strict=True):
                    f[:, 0] = a
                for i in range(n if again.any() else 0):
                    for f, a in zip(fits, line_fits(np.delete(x[again], i, 1), np.delete(v[again], i, 1)), strict=True):
                        f[again, i + 1] = a
                for j, f in enumerate(fits):
                    out[at, j] = [g if k else g[:1] for g, k in zip(f, again, strict=True)]
        return pd.DataFrame({name: out[:, j] for j, name in enumerate(("nmad", "slope", "intercept"))})

    fitted = F.pandas_udf(lines, "nmad array<double>, slope array<double>, intercept array<double>")
    known = lambda c: F.when(~F.isnan(c), c)
    year = lambda i: F.when(i > 0, F.get("_s", i - 1)["t"])
    each = F.transform("_f.nmad", lambda v, i: F.struct(year(i).alias("_o"), F.round(known(v), 6).alias("nmad"), known(F.get("_f.slope", i)).alias("slope"), known(F.get("_f.intercept", i)).alias("intercept")))
    got = kept.withColumn("_f", fitted("_s.t", "_s.y")).withColumn("_l", each)
    better = lambda a, x: F.when((a["nmad"] > rough) & (x["nmad"] < a["nmad"]), x).otherwise(a)
    best = F.aggregate(F.slice("_l", 2, F.size("_l")), F.get("_l", F.lit(0)), better)
    return got.select(*keys, best.alias("_b")).select(*keys, F.col("_b._o").alias("left_out"), *(F.col(f"_b.{c}").alias(c) for c in ("nmad", "slope", "intercept")))


def polynomial_fit(df: DataFrame, keys: list[str], t: str, y: str, degree: int, scale: float = 1.0) -> DataFrame:
    """keys, n, coefficients (array, of t to the 0 first): least squares by key from one aggregation of sums of powers.

    With too few values of t for ``degree`` the degree is lowered to what they determine, and the coefficients beyond are 0. ``t``
    should be counted from about its middle; ``scale`` (about half its range) keeps the sums of one size. The equations are solved by
    elimination in expressions, so no key is a group of a user function.
    """
    u = F.col(t) / F.lit(float(scale))
    power = lambda k: F.lit(1.0) if k == 0 else F.pow(u, F.lit(float(k)))
    rows = df.where(F.col(t).isNotNull() & F.col(y).isNotNull())
    sums = [F.sum(power(k)).alias(f"_s{k}") for k in range(2 * degree + 1)] + [F.sum(power(k) * F.col(y)).alias(f"_t{k}") for k in range(degree + 1)]
    x = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(t).alias("_m"), *sums)
    minus = lambda first, parts: sum((-p for p in parts), first)
    for i in range(degree + 1):  # rows of the factors: _l{i}_{j} below the diagonal, _d{i} on it
        for j in range(i):
            rest = minus(F.col(f"_s{i + j}"), [F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}") * F.col(f"_d{k}") for k in range(j)])
            x = x.withColumn(f"_l{i}_{j}", F.when(F.col("_m") > j, F.try_divide(rest, F.col(f"_d{j}"))).otherwise(0.0))
        x = x.withColumn(f"_d{i}", minus(F.col(f"_s{2 * i}"), [F.col(f"_l{i}_{k}") * F.col(f"_l{i}_{k}") * F.col(f"_d{k}") for k in range(i)]))
        x = x.withColumn(f"_z{i}", minus(F.col(f"_t{i}"), [F.col(f"_l{i}_{k}") * F.col(f"_z{k}") for k in range(i)]))
    for i in reversed(range(degree + 1)):
        own = F.when(F.col("_m") > i, F.try_divide(f"_z{i}", f"_d{i}")).otherwise(0.0)
        x = x.withColumn(f"_c{i}", F.when(F.col("_m") > i, minus(own, [F.col(f"_l{k}_{i}") * F.col(f"_c{k}") for k in range(i + 1, degree + 1)])).otherwise(0.0))
    return x.select(*keys, "n", F.array(*(F.col(f"_c{i}") / F.lit(float(scale) ** i) for i in range(degree + 1))).alias("coefficients"))
