"""Whitening, license scans and hard negatives against brute force, on the small table and on awkward rows."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.llm import hard_negatives, license_scan, queries, whitening

from .test_operators import AWKWARD, same

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def vectors(rng, n, d=6):
    """Rows with ties, repeated rows, null ids and labels, and vectors that are left out."""
    rows = [(i, [round(rng.gauss(0, 1), 2) for _ in range(d)], rng.randrange(3)) for i in range(n)]
    rows += [(n + i, rows[3][1], i % 3) for i in range(8)] + [rows[4], rows[4]]
    rows += [(None, rows[5][1], 1), (50, None, 1), (51, [1.0] * (d - 1) + [None], 2), (52, [math.nan] * d, 0), (53, [math.inf] + [0.0] * (d - 1), 0), (54, [1.0, 2.0], 0), (100, rows[6][1], None)]
    return rows


def usable(rows, d=6):
    return [r for r in rows if r[1] is not None and len(r[1]) == d and all(x is not None and math.isfinite(x) for x in r[1])]


def brute_whitening(x):
    n, s = len(x), x.sum(0)
    centred = x - s / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - s) ** 2).sum(1), e[::-1], q[:, ::-1], centred


def check_whitening(got, rows, components):
    c = np.array([np.float32(r[1]) for r in rows], float)
    x = np.floor(64 * c).astype(np.int64) + 1_000_000
    n, deviation, e, q, centred = brute_whitening(x)
    assert len(got) == len(rows) * components and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, set()).add(r.whitened)
    signs = {}
    for i, row in enumerate(rows):
        mine = by[row[0], int(deviation[i])]
        for j in range(components):
            want = centred[i] @ q[:, j] / math.sqrt(e[j])
            have = min(mine[j + 1], key=lambda v: abs(abs(v) - abs(want)))
            assert abs(abs(have) - abs(want)) < 1e-6
            if abs(want) > 1e-6:
                signs.setdefault(j, set()).add(math.copysign(1, have) == math.copysign(1, want))
    assert all(len(s) == 1 for s in signs.values())
    share = {r.component: r.explained for r in got}
    assert all(abs(share[j + 1] / (e[j] / e.sum()) - 1) < 1e-8 for j in range(components))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_whitening_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{sf}/embeddings.parquet").to_pylist()]
    check_whitening(queries.op11_whitening(spark, sf).collect(), rows, 32)


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_awkward(spark, parts):
    rows = vectors(random.Random(1), 90)
    df = spark.createDataFrame(rows, EMBEDDINGS).withColumns({"n": F.lit("n"), "x": F.lit(1), "whitened": F.lit(2), "key": F.lit(3)}).repartition(parts)
    got = whitening.whiten_embeddings(df)
    assert got.columns == ["vec_id", "embedding", "label", "x", "key", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = got.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    check_whitening(flat.select("vec_id", "n", "deviation", "whitened", "identity_error", (F.col("at") + 1).alias("component"), F.get("explained", "at").alias("explained")).collect(), usable(rows), 6)


def test_whitening_loses_no_dimension():
    """Merging in any order gives the sums, mean and covariance of all rows, far from the origin too."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(500, 9)) * np.logspace(0, 5, 9)).astype(np.int64) + 10**12
    cuts = [0, 1, 2, 40, 41, 300, 500]
    parts = [whitening.Summary.of(x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    got = whitening.merged(parts[::-1])
    y = x - 10**12
    want = np.cov(y.T.astype(float), bias=True)
    assert got.n == 500 and (got.sums == x.sum(0)).all() and np.abs(got.covariance() - want).max() <= 1e-12 * want.max()
    assert np.allclose(got.mean + (got.origin - 10**12), y.mean(0), rtol=1e-12, atol=1e-9)


def test_whitening_without_variance(spark):
    none = whitening.whiten_embeddings(spark.createDataFrame([], EMBEDDINGS))
    assert none.count() == 0 and "identity_error" in none.columns
    flat = whitening.whiten_embeddings(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], EMBEDDINGS)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat] == [(5, 0, [None, None], [None, None], None)] * 5
    line = whitening.whiten_embeddings(spark.createDataFrame([(i, [float(i), 2.0 * i], 0) for i in range(5)], EMBEDDINGS)).collect()
    assert all(r.whitened[1] is None and abs(r.explained[0] - 1) < 1e-12 and r.identity_error < 1e-9 for r in line)
    with pytest.raises(Exception, match="(?i)overflow"):
        whitening.whiten_embeddings(spark.createDataFrame([(1, [1e30], 0), (2, [-1e30], 0)], EMBEDDINGS)).collect()


def brute_negatives(rows, positives=5, negatives=3):
    rows = [(i, v, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, label in rows if label is not None]
    last = lambda i: math.inf if i is None else i
    out = []
    for a, anchor in enumerate(rows):
        if anchor[0] is None or anchor[0] % 50:
            continue
        scored = sorted(((sum(x * y for x, y in zip(anchor[3], r[3], strict=True)), r[0], r[2]) for b, r in enumerate(rows) if b != a), key=lambda t: (-t[0], last(t[1])))
        for ps, pid, _ in [t for t in scored if t[2] == anchor[2]][:positives]:
            good = [t for t in scored if t[2] != anchor[2] and 50 * ps <= 100 * t[0] <= 95 * ps][:negatives]
            out += [(anchor[0], pid, k + 1, t[1], ps, t[0]) for k, t in enumerate(good)]
    return out


COLS = "anchor_id positive_id rank negative_id positive_score negative_score"


@pytest.mark.parametrize("anchors,rows,first", [(1024, 4096, 64), (2, 7, 2)])
def test_hard_negatives_awkward(spark, monkeypatch, anchors, rows, first):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "ROWS", rows)
    table = vectors(random.Random(2), 260)
    df = spark.createDataFrame(table, EMBEDDINGS).withColumns({c: F.lit(1) for c in ("row", "x", "g", "n", "anchor")}).repartition(5)
    same(hard_negatives.mine(df, F.col("vec_id") % 50 == 0), COLS, brute_negatives(usable(table)))


def test_pairs_are_dropped_early_and_none_is_lost():
    """With few leading dimensions that matter most pairs are never scored; the best are those of a full product."""
    rng = np.random.default_rng(4)
    scale = np.r_[np.full(8, 200.0), np.full(56, 2.0)]
    a, b = (np.floor(rng.normal(size=(n, 64)) * scale).astype(np.int64) for n in (20, 5000))
    q = np.eye(64)
    full = a @ b.T
    scored = []
    einsum = np.einsum
    hard_negatives.np.einsum = lambda *x: scored.append(len(x[1])) or einsum(*x)
    try:
        e, r, s = hard_negatives.best(hard_negatives.Turned(a, q), hard_negatives.Turned(b, q), np.arange(20), np.full(20, -(10**15)), np.full(20, 10**15), 3, lambda lo, hi: np.ones((20, hi - lo), bool))
    finally:
        hard_negatives.np.einsum = einsum
    for i in range(20):
        want = sorted(range(5000), key=lambda j: (-full[i, j], j))[:3]
        assert r[e == i].tolist() == want and s[e == i].tolist() == [full[i, j] for j in want]
    assert sum(scored) < 0.05 * full.size


def test_hard_negatives_without_rows(spark):
    for rows in ([], [(50, [1.0, 1.0], 1)], [(50, [1.0, 1.0], 1), (50, [1.0, 1.0], 1)], [(1, [1.0, 1.0], 1), (2, [1.0, 1.0], 1)]):
        assert hard_negatives.mine(spark.createDataFrame(rows, EMBEDDINGS), F.col("vec_id") % 50 == 0).count() == 0


LICENSED = [
    *AWKWARD,
    (60, "x\nReleased under the MIT License.\ny"), (61, "Released under the\nMIT License"), (62, "CC-BY cc by! CC,BY"), (63, "all rights\n\nreserved and ALL RIGHTS RESERVED"),
    (64, "the mit license released under the mit, released"), (65, "GNU General Public License"), (66, "This is licensed under the GNU General Public License version 3"),
    (67, "intro\n\n" + license_scan.TEMPLATES[5].text.replace(",", ",\n") + "\n\nend"), (68, "# " + license_scan.TEMPLATES[7].text.replace("that ", "\n# ") + "\n#\n# more"),
    (69, " ".join(license_scan.TEMPLATES[9].text.split()[:20])), (70, "Licensed under CC BY-NC 4.0.\n" * 3), (70, "Licensed under CC BY-NC 4.0.\n" * 3), (None, "All rights reserved."),
    (71, "cc " * 2000 + "by"), (72, "word " * 30000 + "\n" + "a" * 1_200_000 + " all rights reserved"),
]


def brute_licenses(rows):
    import re

    out = []
    for d, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) if w]
        w = split(low)
        places, base = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            base |= {label} if at else set()
        labels, score = set(base), 1.0 if base else 0.0
        for paragraph in re.split(r"\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n", low):
            for unit, block in [("paragraph", paragraph), *(("line", x) for x in paragraph.split("\n"))]:
                have = set(split(block))
                for t in license_scan.TEMPLATES:
                    held = len(have & set(t.words)) / len(t.words)
                    if t.unit == unit and held >= license_scan.THRESHOLD[unit] - 1e-12:
                        labels.add(t.label)
                        score = max(score, held)
        out.append((d, len(w), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(labels), score))
    return out


def test_licenses(spark):
    df = spark.createDataFrame([(d, t, 1, "b", "l") for d, t in LICENSED], "doc_id long, text string, row int, line string, label string")
    got = license_scan.scan_licenses(df)
    same(got, "doc_id n_words n_base first_word last_word base_labels labels score", brute_licenses(LICENSED))
    labels = {r.doc_id: r.labels for r in got.collect()}
    assert labels[67] == ["mit"] and labels[68] == ["bsd"] and labels[66] == ["gpl", "gpl-3.0"] and labels[64] == ["mit"] and labels[61] == [] and labels[70] == ["cc-by", "cc-by-nc"]


def test_licenses_with_other_templates(spark):
    """Random sets, so that prefixes, lengths and places decide."""
    rng = random.Random(6)
    templates = [license_scan.Template(f"t{i}", rng.choice(["line", "paragraph"]), " ".join(f"w{int(rng.expovariate(0.15))}" for _ in range(rng.randint(1, 14)))) for i in range(12)]
    rows = [(d, "\n".join(" ".join(f"w{int(rng.expovariate(0.15))}" for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(0, 6)))) for d in range(300)]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates, phrases={}).collect()}
    for d, text in rows:
        want, score = set(), 0.0
        paragraphs = [p for p in __import__("re").split(r"\n[ \n]*\n", text)]
        for unit, block in [b for p in paragraphs for b in [("paragraph", p), *(("line", x) for x in p.split("\n"))]]:
            for t in templates:
                share = len(set(block.split()) & set(t.words)) / len(t.words)
                if t.unit == unit and share >= license_scan.THRESHOLD[unit] - 1e-12:
                    want.add(t.label)
                    score = max(score, share)
        assert got[d] == (sorted(want), score)


def test_licenses_of_no_rows(spark):
    assert license_scan.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.labels for r in license_scan.scan_licenses(spark.createDataFrame([(1, "cc by")], "doc_id long, text string"), templates=[]).collect()] == [["cc-by"]]


def test_settings_with_units(spark, awkward_docs):
    from gridloom.llm import common, quality_rules

    assert [common.size_of(x) for x in ("4194304", "64m", "3kb", "2g", "-1")] == [4 << 20, 64 << 20, 3 << 10, 2 << 30, -1]
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        assert quality_rules.rate_documents(awkward_docs).count() == len(AWKWARD)
        assert common.size_of(spark.conf.get(name)) == common.BATCH_BYTES
    finally:
        spark.conf.set(name, before)


@pytest.fixture(scope="module")
def awkward_docs(spark):
    return spark.createDataFrame([(d, t, "s") for d, t in AWKWARD], "doc_id long, text string, source string")


def test_shards_with_clashing_columns(awkward_docs):
    from gridloom.llm import sharding

    names = ["_rows", "_k0", "_k1", "_w", "_h", "_cell", "_place", "_row", "_i0", "shard"]
    df = awkward_docs.withColumns({c: F.lit(c) for c in names})
    got = sharding.interleave(df, 3, keys=("doc_id", "text"))
    assert got.columns == ["doc_id", "text", "source", *names[:-1], "shard", "slot"] and all(r[c] == c for r in got.collect() for c in names[:-1])
    same(got.select("doc_id", "text", "shard", "slot"), "doc_id text shard slot", [tuple(r) for r in sharding.interleave(awkward_docs, 3, keys=("doc_id", "text")).select("doc_id", "text", "shard", "slot").collect()])


def test_rules_are_planned_on_short_texts(spark):
    from gridloom.llm import quality_rules

    seen = []
    docs = spark.createDataFrame([(i, "a b c " * (20_000 if i % 2 else 20)) for i in range(400)], "doc_id long, text string")
    ordered = quality_rules.ordered
    quality_rules.ordered = lambda rules, bodies: seen.extend(map(len, bodies)) or ordered(rules, bodies)
    try:
        quality_rules.plan(docs)
    finally:
        quality_rules.ordered = ordered
    assert seen and max(seen) <= 64 << 10
