"""A quality classifier with hierarchical empirical Bayes over sites.

A document's evidence is the log odds of a logistic model over its words and a few measures, fitted on a bounded
sample of labelled rows. A host's and a path's own rates are estimated from the documents' probabilities by grouped
aggregation: the global rate is the prior of hosts, a host's posterior that of its paths, and the strength of either prior
(pseudo-documents) follows from how much group means vary beyond what their sizes explain. Sites with few documents so
stay near the prior above them. The posterior log odds are the document's evidence plus the path's.

Null and empty texts have no evidence either way; a null host or path is a site of its own. Ids may repeat; each row is rated
by itself. Labelled rows whose id has several labels, or a text beyond ``FIT_BYTES``, are not fitted on; of rows with one id the
least text is. Without labels of both classes the evidence is the same for all. Texts of any length are read whole; an empty
table gives none.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, map_arrow
from gridloom.llm.quality_rules import Page

#: The most labelled rows that a model is fitted on.
FIT_ROWS = 4_000
#: The longest text that a model is fitted on, so that the driver gets FIT_ROWS times as many bytes at most.
FIT_BYTES = 32_768


def measures(body: bytes) -> list[bytes]:
    """Features that are no words: measures in coarse steps (their names can't be words, which hold no space)."""
    p = Page(body)
    n = max(1, p.n_words)
    steps = (
        ("words", min(6, p.n_words.bit_length() // 2)), ("symbols", min(5, int(10 * p.n_symbols / n))), ("length", min(12, p.word_chars // n)),
        ("dup lines", int(5 * p.n_dup_lines / max(1, len(p.lines)))), ("repeats", int(5 * p.n_repeat_words / n)),
        ("upper", int(5 * p.n_upper / max(1, p.n_letters))), ("bangs", min(5, int(10 * p.body.count(b"!!") / n))),
    )
    return [f"{name} {step}".encode() for name, step in steps]


@dataclass(frozen=True)
class Evidence:
    """Log odds of a logistic model: base plus the weights of the features present (of ``features``)."""

    base: float
    weights: dict[bytes, float]

    def score(self, features: set[bytes]) -> float:
        w = self.weights
        return self.base + sum([w[x] for x in features & w.keys()])


#: Characters of a word's beginning that are a feature too, so that unseen forms of a word count.
BEGINNING = 4
EDGES = b".,;:!?\"()"


def features(body: bytes) -> set[bytes]:
    """Distinct words in lower case without punctuation at their ends, their beginnings (marked by a blank), and the measures."""
    words = {x.strip(EDGES) for x in body.lower().split()}
    starts = {b" " + (x[:BEGINNING] if x.isascii() else x.decode()[:BEGINNING].encode()) for x in words if len(x) >= BEGINNING}
    return {*words, *starts, *measures(body)}


def fit(rows: list[tuple[bytes, int]], most: int = 400, ridge: float = 0.3) -> Evidence:
    """A logistic model with a ridge penalty, by Newton steps, over the ``most`` features that tell the classes apart best
    (log odds ratio in standard errors)."""
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    if not n1 or not n0:
        return Evidence(math.log((n1 + 1) / (n0 + 1)), {})
    sets = [features(body) for body, _ in rows]
    seen = {0: Counter(), 1: Counter()}
    for x, (_, y) in zip(sets, rows, strict=True):
        seen[y].update(x)

    def apart(x: bytes) -> float:
        a, b = seen[1][x] + 0.5, seen[0][x] + 0.5
        c, d = n1 - a + 1, n0 - b + 1
        return abs(math.log(a * d / (b * c))) / math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)

    names = sorted({*seen[0], *seen[1]}, key=lambda x: (-apart(x), x))[:most]
    at = {x: j for j, x in enumerate(names)}
    m = np.zeros((len(rows), len(names) + 1))
    m[:, -1] = 1
    for i, x in enumerate(sets):
        m[i, [at[f] for f in x if f in at]] = 1
    y, w = np.array([y for _, y in rows], float), np.zeros(len(names) + 1)
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve((m.T * (p * (1 - p) + 1e-9)) @ m + np.diag(penalty), m.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Evidence(float(w[-1]), {x: float(v) for x, v in zip(names, w, strict=False)})


def labelled(docs: DataFrame, labels: DataFrame, target: str, id_col: str, text_col: str, rows: int) -> list[tuple[bytes, int]]:
    """``rows`` labelled texts at most, least by a hash of their id."""
    y = labels.select(F.col(id_col).alias("_i"), F.col(target).cast("int").alias("y")).where("_i is not null and y in (0, 1)")
    y = y.groupBy("_i").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    y = y.orderBy(F.xxhash64(F.lit(3), "_i"), "_i").limit(rows)
    texts = docs.select(F.col(id_col).alias("_i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where(F.octet_length("t") <= FIT_BYTES)
    got = texts.join(F.broadcast(y), "_i").groupBy("_i", "y").agg(F.min("t").alias("t")).collect()
    return [(r["t"].encode(), r["y"]) for r in sorted(got, key=lambda r: r["_i"])]


def _strength(groups: DataFrame) -> float:
    """groups: n, s. Pseudo-rows of a beta prior by the method of moments, weighting groups by rows."""
    r = groups.where("n > 1").agg(F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n"), 2)).alias("Q"), F.count("*").alias("k")).first()
    if not r["N"] or r["k"] < 2:
        return 10.0
    m = r["S"] / r["N"]
    inner = m * (1 - m)
    between = max(1e-9, r["Q"] / r["N"] - m * m - inner * r["k"] / r["N"])
    return float(min(1e4, max(2.0, inner / between - 1)))


def rate(docs: DataFrame, labels: DataFrame, target: str = "quality", host: str = "source", path: str = "lang", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, models: dict[str, Evidence] | None = None, also: tuple[str, ...] = ("toxic",), also_under: float = 0.25) -> DataFrame:
    """A row per row: id, host, path, evidence (log odds), host_rate, path_rate, posterior, and for each of ``also`` its
    probability by the text alone; ``kept``: posterior at least 0.5 and all of ``also`` under ``also_under``."""
    models = models or {t: fit(labelled(docs, labels, t, id_col, text_col, fit_rows)) for t in (target, *also)}

    def run(batches):
        for batch in batches:
            out = {t: [] for t in (target, *also)}
            for body in batch.column("body").to_pylist():
                x = features(body) if body else None
                for t, m in models.items():
                    out[t].append(0.0 if x is None else m.score(x))
            yield {"doc_id": batch.column("doc_id"), "host": batch.column("host"), "path": batch.column("path"), **{f"e_{t}": v for t, v in out.items()}}

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text_col).cast("binary").alias("body"))
    scored, _ = cut(map_arrow(slim, run, "doc_id long, host string, path string, " + ", ".join(f"e_{t} double" for t in (target, *also))), "evidence")
    chance = lambda e: 1 / (1 + F.exp(-e))
    e = F.col(f"e_{target}")
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(chance(e)).alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    m = ((total["s"] or 0.0) + 1) / ((total["n"] or 0) + 2)
    ks, kp = _strength(hosts), _strength(paths)
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("s") + m * ks) / (F.col("n") + ks)).alias("host_rate"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select("h", F.col("path").alias("p"), "host_rate", ((F.col("s") + F.col("host_rate") * kp) / (F.col("n") + kp)).alias("path_rate"))
    rows = scored.join(paths, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    odds = lambda x: F.log(x / (1 - x))
    posterior = chance(e + odds(F.col("path_rate")) - math.log(m / (1 - m)))
    rows = rows.select("doc_id", "host", "path", e.alias("evidence"), "host_rate", "path_rate", posterior.alias("posterior"), *(chance(F.col(f"e_{t}")).alias(f"{t}_probability") for t in also))
    kept = F.col("posterior") >= 0.5
    for t in also:
        kept = kept & (F.col(f"{t}_probability") < also_under)
    return rows.withColumn("kept", kept)
