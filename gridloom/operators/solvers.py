"""Fits: robust polynomials by block, variogram models, farthest points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.sources.files import stored


def huber_fit(design: np.ndarray, y: np.ndarray, scale: float = 1.345, rounds: int = 30) -> np.ndarray:
    """Least squares with Huber's weights, the scale from the residuals' median deviation."""
    w = np.ones(len(y))
    beta = np.zeros(design.shape[1])
    for _ in range(rounds):
        root = np.sqrt(w)[:, None]
        new = np.linalg.lstsq(design * root, y * root[:, 0], rcond=None)[0]
        res = y - design @ new
        spread = max(1.4826 * np.median(np.abs(res - np.median(res))), 1e-12)
        w = np.minimum(1.0, scale * spread / np.maximum(np.abs(res), 1e-12))
        if np.allclose(new, beta, rtol=1e-10, atol=1e-12):
            break
        beta = new
    return beta


def sampled_polynomial(t: np.ndarray, y: np.ndarray, degree: int, limit: float, rng: np.random.Generator, draws: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients of t, t^2 ... , inliers): of seeded draws of ``degree`` points that with the most within ``limit``, fitted again on these."""
    powers = t[:, None] ** np.arange(1, degree + 1)
    best = np.zeros(len(t), bool)
    for _ in range(draws):
        pick = rng.choice(len(t), min(len(t), degree + 1), replace=False)
        beta = np.linalg.lstsq(powers[pick], y[pick], rcond=None)[0]
        near = np.abs(y - powers @ beta) <= limit
        if near.sum() > best.sum():
            best = near
    if not best.any():
        best = np.ones(len(t), bool)
    return np.linalg.lstsq(powers[best], y[best], rcond=None)[0], best


def shifted(coefficients: np.ndarray, origin: float) -> np.ndarray:
    """Coefficients (lowest first) of the polynomial in t + origin that has these in t."""
    out = np.zeros(len(coefficients))
    for c in coefficients[::-1]:
        out = np.append(0.0, out[:-1]) - origin * out
        out[0] += c
    return out


def block_polynomials(df: DataFrame, keys: list[str], degrees: tuple[int, ...] = (1,), limit: float | None = None, origin: float = 0.0, seed: int = 0) -> DataFrame:
    """df: keys, x, y, t, z. A robust plane through a block's middle is fitted to what the values of each time are off their median, and
    taken off; then for each degree a polynomial in time without an intercept is fitted by seeded draws.

    A row per block and degree: coefficients (of t + ``origin``, lowest first, as many as the largest degree has), nmad of all
    residuals, score (of the inliers), n_in, n, slope_x, slope_y. ``limit`` is how far inliers are; the values' median absolute
    deviation if it is None. Blocks with under degree + 3 values have no coefficients. A block, a bounded number of cells, is one
    task's.
    """
    most = max(degrees)

    def fit(block: pd.DataFrame) -> pd.DataFrame:
        b = block.dropna(subset=["t", "z"]).sort_values(["t", "x", "y", "z"])
        head = {k: block[k].iloc[0] for k in keys}
        none = {"coefficients": None, "nmad": np.nan, "score": np.nan, "n_in": 0, "n": len(b), "slope_x": np.nan, "slope_y": np.nan}
        rows = []
        for degree in degrees:
            if len(b) < degree + 3:
                rows.append({**head, "degree": degree, **none})
                continue
            t, z = b.t.to_numpy(float), b.z.to_numpy(float)
            place = np.column_stack([b.x - (block.x.min() + block.x.max()) / 2, b.y - (block.y.min() + block.y.max()) / 2]).astype(float)
            slopes = huber_fit(place, z - b.groupby("t").z.transform("median").to_numpy(float))
            rest = z - place @ slopes
            near = limit if limit is not None else float(np.median(np.abs(rest - np.median(rest))))
            beta, inside = sampled_polynomial(t, rest, degree, near, np.random.default_rng(seed))
            res = rest - (t[:, None] ** np.arange(1, degree + 1)) @ beta
            spread = ((rest[inside] - rest[inside].mean()) ** 2).sum()
            full = shifted(np.concatenate([[0.0], beta, np.zeros(most - degree)]), origin)
            rows.append({
                **head, "degree": degree, "coefficients": full.tolist(), "nmad": 1.4826 * np.median(np.abs(res - np.median(res))), "score": 1 - (res[inside] ** 2).sum() / spread if spread > 0 else np.nan,
                "n_in": int(inside.sum()), "n": len(b), "slope_x": slopes[0], "slope_y": slopes[1],
            })
        return pd.DataFrame(rows)

    types = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    return df.groupBy(*keys).applyInPandas(fit, f"{types}, degree int, coefficients array<double>, nmad double, score double, n_in int, n int, slope_x double, slope_y double")


def fit_spherical(lags: list[float], gamma: list[float], weights: list[float]) -> tuple[float, float, float]:
    """(nugget, sill, range) of a spherical model: ranges are scanned, the rest is weighted least squares without negative parts."""
    h, g, w = np.array(lags, float), np.array(gamma, float), np.sqrt(np.array(weights, float))
    best = None
    for reach in np.linspace(h.min() + 1e-9, 2 * h.max(), 200):
        s = np.where(h < reach, 1.5 * h / reach - 0.5 * (h / reach) ** 3, 1.0)
        for design in (np.column_stack([np.ones_like(s), s]), np.column_stack([np.zeros_like(s), s])):
            beta = np.linalg.lstsq(design * w[:, None], g * w, rcond=None)[0]
            cost = float((((design @ beta - g) * w) ** 2).sum())
            if (beta >= -1e-12).all() and (best is None or cost < best[0]):
                best = (cost, float(beta[0]), float(beta[1]), float(reach))
    return best[1:] if best else (0.0, 0.0, float(h.max()))


def farthest_points(points: DataFrame, n: int) -> DataFrame:
    """points: pid, x, y. (pid, place): greedily from the least pid on always the one farthest from those taken, the least pid of equals.

    A round is one aggregation over all points, with the places taken so far as literals; only the winner's row passes the driver.
    """
    rows = stored(points.select("pid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(), "points")
    first = rows.agg(F.min(F.struct("pid", "x", "y")).alias("p")).first().p
    taken = [first] if first else []
    while taken and len(taken) < n:
        gaps = [(F.col("x") - p.x) * (F.col("x") - p.x) + (F.col("y") - p.y) * (F.col("y") - p.y) for p in taken]
        near = F.least(*gaps) if len(gaps) > 1 else gaps[0]
        best = rows.where(~F.col("pid").isin([p.pid for p in taken])).agg(F.max_by(F.struct("pid", "x", "y"), F.struct(near, -F.col("pid"))).alias("p")).first().p
        if best is None:
            break
        taken.append(best)
    return points.sparkSession.createDataFrame([(p.pid, i) for i, p in enumerate(taken)], "pid long, place int")


def window_lines(t: np.ndarray, y: np.ndarray, pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slope, intercept, count) of the line through the inliers of the best draw, for every row of ``t`` and ``y``; NaN without a line."""
    limit = np.median(np.abs(y - np.median(y, 1)[:, None]), 1)
    best_n, best_off, best = np.zeros(len(t), int), np.full(len(t), np.inf), np.zeros(t.shape, bool)
    for i, j in pairs:  # in their order, so the first of equals stays
        step = t[:, j] - t[:, i]
        slope = (y[:, j] - y[:, i]) / np.where(step != 0, step, np.nan)
        off = np.abs(y - y[:, i, None] - slope[:, None] * (t - t[:, i, None]))
        near = off <= limit[:, None] + 1e-9
        n, total = near.sum(1), np.round(np.where(near, off, 0.0).sum(1), 9)
        better = (n >= 2) & ((n > best_n) | ((n == best_n) & (total < best_off)))
        best_n[better], best_off[better], best[better] = n[better], total[better], near[better]
    n = np.where(best_n > 0, best_n, np.nan)
    mt, my = np.where(best, t, 0.0).sum(1) / n, np.where(best, y, 0.0).sum(1) / n
    dt = np.where(best, t - mt[:, None], 0.0)
    sxx = (dt * dt).sum(1)
    slope = (dt * (y - my[:, None])).sum(1) / np.where(sxx > 0, sxx, np.nan)
    return slope, my - slope * mt, best_n


def rolling_ransac(df: DataFrame, keys: list[str], t: str, y: str, width: int = 4, draws: int = 12) -> DataFrame:
    """A line by seeded draws in every window of ``width`` consecutive values of a key (by ``t``): keys, t0 (the window's first),
    slope, intercept, n_in. Draws are pairs of values; inliers lie within the window's median absolute deviation; of the draws with
    the most inliers that with the least residuals is fitted again on them. A short series is a short array; the windows of a batch of
    rows are fitted together, no key is a group of a user function.
    """
    series = df.where(F.col(t).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), F.col(y).cast("double").alias("y")))).alias("p"))
    starts = F.sequence(F.lit(1), F.size("p") - width + 1)
    w = series.where(F.size("p") >= width).withColumn("s", F.explode(starts)).select(*keys, F.slice("p", F.col("s"), width).alias("p"))
    w = w.select(*keys, *(F.get("p", F.lit(i))["t"].alias(f"_t{i}") for i in range(width)), *(F.get("p", F.lit(i))["y"].alias(f"_y{i}") for i in range(width)))
    pairs = [(k * 7919 % width, (k * 7919 % width + 1 + k * 104729 % (width - 1)) % width) for k in range(draws)]
    pairs = sorted({tuple(sorted(ij)) for ij in pairs})

    def lines(batches):
        for b in batches:
            x, v = (b[[f"_{k}{i}" for i in range(width)]].to_numpy(float) for k in "ty")
            slope, intercept, n = window_lines(x, v, pairs)
            yield b[keys].assign(t0=x[:, 0], slope=slope, intercept=intercept, n_in=n.astype(np.int32))

    kinds = {f.name: f.dataType.simpleString() for f in w.schema}
    return w.mapInPandas(lines, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", t0 double, slope double, intercept double, n_in int")


def first_of_each(df: DataFrame, group: str, key: str, bits: int, tie: str, most: int) -> DataFrame:
    """The ``most`` rows of every group that come first by ``key`` (a whole number, about evenly spread) and ``tie``, with their place ``k``
    from 1; as all rows' order by a window gives them.

    Rows are counted by the key's leading bits (it is cut by the last ``bits``: a few thousand counts a group); only rows up to the
    cut that holds the last wanted one are ordered, so no task sorts what isn't near the front. Groups are few.
    """
    cut = F.shiftright(key, bits)
    counts = df.groupBy(group, cut.alias("_cut")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_cut").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    last = counts.withColumn("_before", before).where(F.col("_before") < most).groupBy(group).agg(F.max("_cut").alias("_last"))
    near = df.join(F.broadcast(last), group).where(cut <= F.col("_last")).drop("_last")  # a row per group
    near = near.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), group)  # few rows, on which much may follow
    return near.withColumn("k", F.row_number().over(W.partitionBy(group).orderBy(key, tie))).where(F.col("k") <= most)


def replicated(points: DataFrame, replicates: int) -> DataFrame:
    """Every point once for each replicate (``rep``), in tasks of their own: a small file's one task would make them all."""
    dealt = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pid")
    return dealt.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))


def pair_bins(xy: np.ndarray, width: float, n: int) -> np.ndarray:
    """How many pairs of places lie in each of ``n`` distance bins, the last with what lies beyond."""
    i, j = np.triu_indices(len(xy), 1)
    d = np.sqrt(((xy[i] - xy[j]) ** 2).sum(1))
    return np.bincount(np.minimum((d / width).astype(int), n - 1), minlength=n)


def balanced_points(points: DataFrame, replicates: int, size: int, width: float, bins: int, candidates: int = 24, seed: int = 0) -> DataFrame:
    """points: pid, x, y. (rep, place, pid, x, y): ``replicates`` samples of ``size`` points whose pair distances fill all bins evenly.

    Each replicate draws a pool of ``size * candidates`` points by the order of a seeded hash, and takes one of ``candidates`` in every round: that whose pairs with those taken go most into the emptiest bins. All
    replicates are one keyed plan; a task holds the pool of one.
    """
    pool = points.select("pid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    pool = replicated(pool, replicates).withColumn("u", F.xxhash64(F.lit(seed), "rep", "pid"))
    pool = first_of_each(pool, "rep", "u", 52, "pid", size * candidates).drop("u")

    def choose(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("k")
        xy, n = df[["x", "y"]].to_numpy(), len(df)
        taken, count = [0], np.zeros(bins)
        free = np.ones(n, bool)
        free[0] = False
        per = max(1, min(candidates, n // max(1, size)))
        while len(taken) < min(size, n):
            each = np.flatnonzero(free)[:per]
            d = np.minimum((np.sqrt(((xy[each, None] - xy[taken]) ** 2).sum(-1)) / width).astype(int), bins - 1)
            best = each[int((1 / (1 + count))[d].sum(1).argmax())]
            count += np.bincount(d[int(np.flatnonzero(each == best)[0])], minlength=bins)
            taken.append(int(best))
            free[each] = False if n >= size * per else free[each]
            free[best] = False
            if not free.any() and len(taken) < min(size, n):
                free[:] = True
                free[taken] = False
        got = df.iloc[taken]
        return pd.DataFrame({"rep": got.rep, "place": np.arange(len(got), dtype=np.int32), "pid": got.pid, "x": got.x, "y": got.y})

    return pool.groupBy("rep").applyInPandas(choose, "rep int, place int, pid long, x double, y double")
