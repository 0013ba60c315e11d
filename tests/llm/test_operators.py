"""The corpus operators against plain-Python versions, on the small table and on awkward rows."""

import io
import itertools
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.llm import classifier, decontaminate, line_dedup, packing, quality_rules, queries, sharding, simhash, substring_dedup, suffix_dedup, warc

from . import brute

PASSAGE = " ".join(f"w{i}é" for i in range(70))
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, PASSAGE), (6, "x y " + PASSAGE + " z"), (7, PASSAGE), (7, PASSAGE), (None, PASSAGE + " tail"),
    (8, "a " * 3000), (9, "line one\nline two\n" * 40), (10, "the\x0bQuick\x1cfox  jumps"), (11, "A" * 5000), (12, PASSAGE[:300]),
    *((20 + i, f"start{i} " + " ".join(f"s{j}" for j in range(60)) + f" end{i}") for i in range(12)),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(d, t, "src", None if d == 5 else 1, "h", 2) for d, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tag long, h string, k long")


@pytest.fixture(scope="module")
def small(sf):
    d = pq.read_table(f"{sf}/documents.parquet").to_pandas()
    return list(zip(d.doc_id.tolist(), d.text.tolist(), strict=True))


def same(df, cols, expected):
    got = [tuple(r[c] for c in cols.split()) for r in df.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_suffix_order():
    rng = random.Random(5)
    for _ in range(500):
        s = [rng.randint(0, rng.choice([1, 2, 9])) for _ in range(rng.randint(0, 60))]
        assert suffix_dedup.lyndon_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("hot", [50_000, 2])
def test_suffix_dedup(awkward, hot):
    same(suffix_dedup.dedup_suffixes(awkward, digest=True, hot=hot), "doc_id n_bytes n_removed n_spans kept_sha256", brute.suffixes(AWKWARD))


@pytest.mark.parametrize("hot", [50_000, 2])
def test_substring_dedup(awkward, hot):
    same(substring_dedup.dedup_substrings(awkward, digest=True, hot=hot), "doc_id n_words n_removed kept_sha256", brute.substrings(AWKWARD))


def test_rules(awkward):
    same(quality_rules.rate_documents(awkward), "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed", brute.rules(AWKWARD))


def test_contamination(spark, awkward):
    items = [(1, "W3é w4é, W5é w6é w7é w8é w9é w10é w11é w12é w13é"), (2, "one"), (2, None), (3, "!!"), (4, "quick FOX"), (10, "a a a a a a a a a a a")]
    found = decontaminate.find_contamination(awkward, spark.createDataFrame(items, "item_id long, text string"))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, brute.sha(",".join(r["items"])), r.n_hit > 0) for r in found.collect()]
    assert sorted(got, key=str) == sorted(brute.contamination(AWKWARD, items), key=str)


def test_simhash(awkward):
    got = simhash.near_duplicates(awkward)
    same(got.selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) as f", "component_id"), "doc_id f component_id", brute.simhash(AWKWARD))


def test_cover_reaches_all_pairs():
    rng, cover = random.Random(3), simhash.Cover(2)
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        a, b = (set(cover.anchors(np.array([v], np.uint64).view(np.int64))[1].tolist()) for v in (x, y))
        assert a & b


@pytest.mark.parametrize("name", ["op2_quality_rules", "op4_suffix_dedup", "op5_decontamination", "op6_substring_dedup", "op10_simhash"])
def test_queries_on_the_table(spark, sf, small, name):
    b = pq.read_table(f"{sf}/benchmark.parquet").to_pandas()
    items = list(zip(b.item_id.tolist(), b.text.tolist(), strict=True))
    cols, expected = {
        "op2_quality_rules": ("doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed", lambda: brute.rules(small)),
        "op4_suffix_dedup": ("doc_id n_bytes n_removed n_spans kept_sha256", lambda: brute.suffixes(small)),
        "op5_decontamination": ("doc_id n_words n_hit n_items items_sha256 contaminated", lambda: brute.contamination(small, items)),
        "op6_substring_dedup": ("doc_id n_words n_removed kept_sha256", lambda: brute.substrings(small)),
        "op10_simhash": ("doc_id fingerprint component_id", lambda: brute.simhash(small)),
    }[name]
    same(queries.QUERIES[name](spark, sf), cols, expected())


def test_sharding(spark, sf, small):
    got = queries.op1_sharding(spark, sf).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(small) and sizes.max() - sizes.min() <= 1
    for _, x in got.groupby("shard"):
        assert sorted(x.slot) == list(range(len(x)))
    by = got.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (by.max(axis=1) - by.min(axis=1)).max() <= 2
    assert dict(zip(got.doc_id, got.text_crc32, strict=True)) == {d: brute.crc(t) for d, t in small}


def test_sharding_cells_do_not_matter(spark, awkward):
    a, b = (sorted((r.doc_id or -1, r.shard, r.slot) for r in sharding.interleave(awkward, 3, keys=("doc_id", "text"), cell_rows=c).collect()) for c in (2, 1000))
    assert a == b


def check_packing(pieces, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for d, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(d, p, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(pieces[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(pieces.doc_id.notna(), None).itertuples(index=False, name=None), key=str) == sorted(want, key=str)
    for _, x in pieces.groupby("sequence_id"):
        x = x.sort_values("offset")
        assert x.offset.tolist() == [0, *itertools.accumulate(x.length)][:-1] and x.length.sum() <= 4096


def test_packing(spark, sf, small):
    check_packing(queries.op7_packing(spark, sf).toPandas(), small)


def test_packing_awkward(awkward):
    rows = [(d, t) for d, t in AWKWARD if d is not None]
    check_packing(packing.pack_documents(awkward.where("doc_id is not null"), queries.tokenizer_path()).toPandas(), rows)


def test_bounded_space():
    rng = random.Random(1)
    used = {}
    lengths = [rng.randint(1, 100) for _ in range(3000)]
    for n, (b, off) in zip(lengths, packing.best_fit(lengths, 100, 8), strict=True):
        assert used.get(b, 0) == off
        used[b] = off + n
    assert max(used.values()) <= 100


def test_warc(spark, sf):
    pages = pq.read_table(f"{sf}/pages.parquet").to_pandas()
    rows = [*zip(pages.page_id.tolist(), pages.html.tolist(), strict=True), (9001, None), (9002, "x" * 99), (9003, "x" * 99), (9004, "é" * 60), (9005, "é" * 60), (9005, "é" * 60), (None, "y" * 200)]
    df = spark.createDataFrame([(p, f"http://a.b/\r\n{p} é", h) for p, h in rows], "page_id long, url string, html string")
    same(warc.archive_round_trip(spark, df), "page_id payload_bytes payload_digest record_type refers_to", brute.warc(rows))


def test_warc_detects_damage():
    good = warc.record(1, "http://a.b", b"payload" * 50, brute.sha(b"payload" * 50), 350, None, "2024-01-01T00:00:00Z")
    assert [r["payload"] for r in warc.read_records(io.BytesIO(warc.member(good) * 3), True)] == [b"payload" * 50] * 3
    for bad in (good.replace(b"payloadpay", b"paXloadpay", 1), good[:-4], good.replace(b"Content-Length: 350", b"Content-Length: 351")):
        with pytest.raises((ValueError, EOFError)):
            list(warc.read_records(io.BytesIO(warc.member(bad))))
    with pytest.raises(EOFError):
        list(warc.read_records(io.BytesIO(warc.member(good)[:-20])))


def brute_lines(rows):
    """Chunks by the operator's boundaries; repeats by bytes in a dictionary."""
    places = {}
    cut = []
    for d, t in rows:
        b = (t or "").encode()
        spans = [(x, y, n) for x, y, n in line_dedup.chunk_spans(b) if n >= 2 and b[x:y].strip()]
        cut.append((d, b, spans))
        for x, y, _ in spans:
            places.setdefault(b[x:y].removesuffix(b"\n"), []).append((1 << 63 if d is None else d, x))
    out = []
    for d, b, spans in cut:
        gone = [(x, y, n) for x, y, n in spans if min(places[b[x:y].removesuffix(b"\n")]) != (1 << 63 if d is None else d, x)]
        kept = b
        for x, y, _ in reversed(gone):
            kept = kept[:x] + kept[y:]
        lines = len(b.split(b"\n")) - (1 if b.endswith(b"\n") or not b else 0)
        out.append((d, lines, sum(n for *_, n in gone), len(gone), brute.sha(kept)))
    return out


def test_line_dedup(spark, sf, small, awkward):
    cols = "doc_id n_lines n_removed_lines n_removed_chunks kept_sha256"
    same(queries.op3_line_dedup(spark, sf), cols, brute_lines(small))
    same(line_dedup.line_report(awkward), cols, brute_lines(AWKWARD))
    kept = line_dedup.dedup_lines(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD)


def test_classifier_on_held_out_rows(spark):
    """Fitted on one half of the labels, by a hash of the id; judged by the other."""
    where = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{where}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    got = classifier.rate(spark.read.parquet(f"{where}/documents.parquet"), labels.where(half == 0)).join(labels.where(half == 1), "doc_id").toPandas()
    assert len(got) > 1500
    clean = (got.quality == 1) & (got.toxic == 0)
    assert got[clean].kept.mean() > 0.95 and got[got.toxic == 1].kept.mean() < 0.1 and got[got.quality == 0].kept.mean() < 0.2


def test_classifier_rates_by_hand(spark):
    """Host and path rates of the grouped aggregation against the formulas over lists."""
    model = classifier.Evidence(0.2, {b"good": 1.5, b"bad": -2.0})
    rows = [(i, ["good one", "bad two", "plain"][i % 3], f"h{i % 4}" if i % 7 else None, f"p{i % 2}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classifier.rate(docs, labels, models={"quality": model}, also=()).collect()}
    e = {i: 0.2 + 1.5 * ("good" in t) - 2.0 * ("bad" in t) for i, t, *_ in rows}
    p = {i: 1 / (1 + np.exp(-x)) for i, x in e.items()}
    m = (sum(p.values()) + 1) / (len(rows) + 2)

    def strength(groups):
        groups = [g for g in groups if len(g) > 1]
        n, s, q = sum(map(len, groups)), sum(map(sum, groups)), sum(sum(g) ** 2 / len(g) for g in groups)
        mean = s / n
        between = max(1e-9, q / n - mean * mean - mean * (1 - mean) * len(groups) / n)
        return min(1e4, max(2.0, mean * (1 - mean) / between - 1))

    hosts, paths = {}, {}
    for i, _, h, q in rows:
        hosts.setdefault(h, []).append(p[i])
        paths.setdefault((h, q), []).append(p[i])
    ks, kp = strength(list(hosts.values())), strength(list(paths.values()))
    host = {h: (sum(x) + m * ks) / (len(x) + ks) for h, x in hosts.items()}
    path = {k: (sum(x) + host[k[0]] * kp) / (len(x) + kp) for k, x in paths.items()}
    for i, _, h, q in rows:
        rate = path[h, q]
        posterior = 1 / (1 + np.exp(-(e[i] + np.log(rate / (1 - rate)) - np.log(m / (1 - m)))))
        assert got[i].host_rate == pytest.approx(host[h]) and got[i].path_rate == pytest.approx(rate) and got[i].posterior == pytest.approx(posterior) and got[i].kept == (posterior >= 0.5)


def test_classifier_awkward(spark, awkward):
    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert classifier.rate(awkward, labels, path="h").count() == len(AWKWARD)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        sharding.interleave(none, 4), quality_rules.rate_documents(none), line_dedup.line_report(none), suffix_dedup.dedup_suffixes(none), decontaminate.find_contamination(none, items),
        substring_dedup.dedup_substrings(none), packing.pack_documents(none, queries.tokenizer_path()), simhash.near_duplicates(none), classifier.rate(none, labels),
        warc.archive_round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.count() == 0


def test_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(out.collect(), out.schema)
            assert 0 < docs.count() <= before
            before = docs.count()
    check_packing(out.toPandas(), [(r.doc_id, r.text) for r in docs.collect()])


def test_similar_groups_follow_the_shingles(spark):
    """Copies at a similarity over 0.9 are in their group, most of those at 0.82; texts changed by half are not."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, groups, border = [], {}, {}
    for g in range(0, 300, 10):
        words = list(rng.choice(vocabulary, 300))
        rows.append((g, " ".join(words)))
        for k, changes in ((1, 1), (2, 3), (3, 6)):
            near = list(words)
            for at in rng.choice(300, changes, replace=False):
                near[at] = "changed"
            rows.append((g + k, " ".join(near).upper()))
        rows.append((g + 4, " ".join(words[:150] + list(rng.choice(vocabulary, 150)))))
        groups |= {g: g, g + 1: g, g + 2: g, g + 4: g + 4}
        border |= {g + 3: g}
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "one"), (None, "nothing else is like this one here")]
    groups |= {1000: 1000, 1001: 1000, 1002: 1002, 1003: 1002, None: None}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert {k: v for k, v in got.items() if k not in border} == groups
    assert sum(got[k] == v for k, v in border.items()) >= 0.7 * len(border)
    kept = simhash.keep_dissimilar(docs)
    assert {r.doc_id for r in kept.collect()} == set(got.values())
    assert simhash.similar(docs.limit(0)).count() == 0


def test_trees_join_what_links_join():
    rng = np.random.default_rng(5)
    pairs = rng.integers(-40, 40, (2, 45))
    trees = simhash.Trees()
    for lo in range(0, 45, 7):
        trees.add(pairs[:, lo : lo + 7])
    groups = {x: {x} for x in pairs.ravel().tolist()}
    for x, y in zip(*pairs.tolist(), strict=True):
        whole = groups[x] | groups[y]
        for z in whole:
            groups[z] = whole
    got = trees.edges()
    assert dict(zip(got["b"].tolist(), got["a"].tolist(), strict=True)) == {x: min(g) for x, g in groups.items() if min(g) != x}
    assert len(got["a"]) == len(set(got["b"].tolist()))
    assert [len(x) for x in simhash.Trees().edges().values()] == [0, 0]


def jaccard_groups(rows, similarity=0.8, shingle=5):
    """Brute force over all pairs: id to the least id of its group."""
    words = [(d, (t or "").encode().lower().split()) for d, t in rows]
    sets = [(d, {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))}) for d, w in words]
    root = {d: d for d, _ in sets}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if len(x & y) >= similarity * len(x | y) - 1e-9 and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {d: lo if r == hi else r for d, r in root.items()}
    return root


def test_similar_is_exact_at_the_threshold(spark, small):
    """Pairs just over 0.8 are all grouped, pairs just under never; the table's groups equal those of all pairs."""
    rng = np.random.default_rng(11)
    rows = [(d, t) for d, t in small if d is not None]
    base = max(d for d, _ in rows) + 1
    for g in range(40):
        words = [f"v{g}x{i}" for i in range(204)]  # 200 shingles
        rows.append((base + 3 * g, " ".join(words)))
        for k, changed in ((1, 4), (2, 5)):  # 180 of 220 shared: 0.818; 175 of 225: 0.778
            near, places = list(words), 10 + 20 * rng.permutation(9)[:changed]
            for at in places:
                near[at] += f"c{k}"
            rows.append((base + 3 * g + k, " ".join(near)))
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_groups(rows)


@pytest.mark.parametrize("keep", [simhash.keep_dissimilar, simhash.keep_representatives])
def test_one_row_a_group_whatever_the_ids(spark, keep):
    """Null ids and an id shared by many texts lose no group; rows of one group leave one."""
    texts = [" ".join(f"t{g}w{i}" for i in range(80)) for g in range(12)]
    ids = [None] * 5 + [7] * 5 + [8, 9]
    rows = [(d, t, n) for n, (d, t) in enumerate(zip(ids, texts, strict=True))]
    rows += [(None, texts[10], 20), (3, texts[0], 21), (7, texts[11], 22), (None, texts[1], 23)]
    got = keep(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted(r.text for r in got) == sorted(texts)
    least = {t: min(((d is None, d) for d, u, _ in rows if u == t), key=str)[1] for t in texts}
    assert {r.text: r.doc_id for r in got} == least


def brute_line_runs(rows):
    """Every line in a pair of consecutive lines (with a word) that an earlier place has is taken out."""
    first, cut = {}, []
    for d, t in rows:
        lines = (t or "").split("\n")
        if lines[-1] == "":
            lines.pop()
        cut.append((d, t or "", lines))
    for d, t, lines in sorted(cut, key=lambda x: (x[0] is None, x[0] or 0)):
        for i, pair in enumerate(itertools.pairwise(lines)):
            first.setdefault(pair, (d, t, i))
    out = []
    for d, t, lines in cut:
        gone = set()
        for i, pair in enumerate(itertools.pairwise(lines)):
            if "\n".join(pair).strip() and first[pair] != (d, t, i):
                gone |= {i, i + 1}
        whole = t.split("\n")
        whole = [x + "\n" for x in whole[:-1]] + ([whole[-1]] if whole[-1] else [])
        runs = sum(i - 1 not in gone for i in gone)
        out.append((d, len(whole), len(gone), runs, brute.sha("".join(x for i, x in enumerate(whole) if i not in gone))))
    return out


def test_line_runs_are_all_found(spark, sf, small):
    """Planted passages of two lines and more are gone wherever they stand; results equal a lookup of every pair of lines."""
    cols = "doc_id n_lines n_removed_lines n_removed_chunks kept_sha256"
    same(queries.QUERIES["op3_line_runs"](spark, sf), cols, brute_line_runs(small))
    passages = [[f"passage {p} line {i}" for i in range(2 + p % 6)] for p in range(30)]
    rows = [(d, "\n".join([f"a{d}", f"b{d}", *passages[d % 30], f"c{d}", f"d{d}"])) for d in range(90)]
    rows += [(200, "x y\nx y\nx y\n"), (201, "\n\n\n\n"), (202, "\n\n\n\nz"), (203, "x y\nx y"), (204, None), (205, ""), (None, "a1\nb1\n"), (206, "a1"), (206, "a1\nb1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(line_dedup.line_run_report(docs), cols, brute_line_runs(rows))
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).where("doc_id < 90").collect()}
    assert all(texts[d] == f"a{d}\nb{d}\nc{d}\nd{d}" for d in range(30, 90)) and all(texts[d] == rows[d][1] for d in range(30))


def test_kept_follows_every_rule(spark, sf, small, awkward):
    same(queries.op2_quality_rules(spark, sf), "doc_id kept", brute.kept(small))
    same(quality_rules.rate_documents(awkward), "doc_id kept", brute.kept(AWKWARD))
    for rules in (quality_rules.default_rules(), quality_rules.default_rules()[::-1]):
        assert sorted(t or "" for (t,) in quality_rules.keep_by_rules(awkward, rules=rules).select("text").collect()) == sorted(t or "" for (_, t), (_, k) in zip(AWKWARD, brute.kept(AWKWARD)) if k)


def test_cascade_order_uses_what_is_left():
    """A rule that only rejects what an earlier one rejects comes last, however much it rejects alone."""
    rules = [quality_rules.Rule("a", lambda p: b"x" in p.body), quality_rules.Rule("b", lambda p: b"x" in p.body or b"z" in p.body), quality_rules.Rule("c", lambda p: b"y" in p.body)]
    bodies = [b"x"] * 6 + [b"y"] * 2 + [b"z"] + [b"k"]
    cost = {"a": 1.0, "b": 1.1, "c": 3.0}
    share = lambda rule, pages: (cost[rule.name], sum(map(rule.rejects, pages)) / max(1, len(pages)))
    assert [r.name for r in quality_rules.ordered(rules, bodies, share)] == ["b", "c", "a"]


def test_shards_are_placed_as_by_sorting(spark, sf):
    d = pq.read_table(f"{sf}/documents.parquet").to_pandas()
    rows = [(i, s, brute.crc(t)) for i, s, t in zip(d.doc_id.tolist(), d.source.tolist(), d.text.tolist(), strict=True)]
    got = queries.op1_sharding(spark, sf)
    same(got, "doc_id shard slot", brute.shards(rows, 16))
    assert {r.doc_id: r.size for r in got.collect()} == {i: len((t or "").encode()) + 1 for i, t in zip(d.doc_id.tolist(), d.text.tolist(), strict=True)}


SHARED = [(None, f"{i} " * 3 + PASSAGE) for i in range(8)] + [(3, f"own{i} " + PASSAGE[:260]) for i in range(6)] + [(None, PASSAGE + " x"), (None, PASSAGE + " x"), (2, None), (2, "")]


def test_rows_without_or_with_one_id(spark):
    """Texts that share a null id, or one id, each have their own result."""
    docs = spark.createDataFrame([(d, t, 1, 2, [3], True, "k") for d, t in SHARED], "doc_id long, text string, r1 int, r2 int, spans array<int>, heavy boolean, tag string")
    same(suffix_dedup.dedup_suffixes(docs, digest=True), "doc_id n_bytes n_removed n_spans kept_sha256", brute.suffixes(SHARED))
    same(substring_dedup.dedup_substrings(docs, digest=True), "doc_id n_words n_removed kept_sha256", brute.substrings(SHARED))
    items = [(1, " ".join(f"w{i}é" for i in range(9, 22))), (None, "own3 w0é")]
    found = decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), slop=3)
    same(found, "doc_id n_words n_hit", [x[:3] for x in brute.contamination(SHARED, items)])
    left = decontaminate.decontaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == docs.columns
    same(left, "doc_id text", [(d, t) for (d, t), x in zip(SHARED, brute.contamination(SHARED, items), strict=True) if not x[5]])
    lines = [(None, f"n{i}\nshared line one\nshared line two\nend{i}") for i in range(5)]
    more = spark.createDataFrame([(d, t, 1, [2], "h") for d, t in lines], "doc_id long, text string, r1 int, spans array<int>, r2 string")
    cleaned = line_dedup.dedup_lines(more)
    assert cleaned.columns == more.columns and sorted(len(r.text.split("\n")) for r in cleaned.collect()) == [2, 2, 2, 2, 4]


def test_near_copies_with_clashing_columns(spark):
    rows = [(i, " ".join(f"t{i // 2}w{j}" for j in range(60)), 1, "k", False, 2) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, key string, none boolean, _c int")
    for keep in (simhash.keep_dissimilar, simhash.keep_representatives):
        got = keep(docs)
        assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [0, 2, 4]


def test_chunks_under_one_digest_are_told_apart(spark):
    """With a digest that is the same for all chunks the bytes decide."""
    rows = AWKWARD + [(d, "\n".join([f"a{d}", *(f"line {i}" for i in range(30)), f"g{d}"])) for d in range(30, 50)]
    base = line_dedup.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    weak, full = (
        sorted((r.r1, sorted(map(tuple, r.spans))) for r in line_dedup.repeated_chunks(base, digest=d).collect()) for d in (lambda c: (0, 0), line_dedup._digest)
    )
    assert weak == full and len(full) > 5


def test_long_texts_are_cut_into_pieces(monkeypatch):
    """The runs of a text beyond the size of a piece cover the same windows under the same minimisers."""
    import pyarrow as pa

    from gridloom.llm import common, repeats

    rng = random.Random(9)
    body = " ".join(rng.choice(["ab", "c", "def", "é"]) for _ in range(4000)).encode()
    for kind in (substring_dedup.word_kind(20, 5, True), suffix_dedup.byte_kind(60, 20, True)):
        seen = []
        for slab in (1 << 20, 300):
            monkeypatch.setattr(repeats, "SLAB", slab)
            monkeypatch.setattr(substring_dedup, "SLAB", slab)
            _, _, buf, ends = next(common.slabs(pa.RecordBatch.from_arrays([pa.array([body])], names=["body"])))
            s = kind.symbols(buf, ends)
            _, h, b, s0, s1 = repeats.run_table(s, kind)
            seen.append([(int(x), int(p), w) for x, p, a, z in zip(h, b, s0, s1, strict=True) for w in range(a, z + 1)])
            assert len(repeats._window_hashes(s, np.arange(0, 900, 7), kind)) == 129
        assert seen[0] == seen[1]


def test_archives_roll_over(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "y" * 500 + str(i) * 300) for i in range(200)], "page_id long, url string, html string").coalesce(2)
    same(warc.archive_round_trip(spark, pages, archive_bytes=2000), "page_id payload_bytes payload_digest record_type refers_to", brute.warc([(r.page_id, r.html) for r in pages.collect()]))


def test_packing_wastes_little(spark, sf):
    """As few sequences as there can be, but for the bins left open: at most one in a hundred more than the tokens fill."""
    p = queries.op7_packing(spark, sf).toPandas()
    assert p.sequence_id.nunique() <= -(-p.length.sum() // 4096) * 1.01 + 1


def test_other_layouts_are_tokenised_whole():
    import public_tokenizers
    import pyarrow as pa

    ids = packing.TextIds(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = ["a  b\n c", "", "don't é 日本"]
    flat, first = ids.encode(pa.array(texts))
    assert not ids.by_parts and [flat[a:b].tolist() for a, b in itertools.pairwise(first.tolist())] == [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    plain = lambda df: sorted((tuple(r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False)), key=str)
    assert plain(got) == plain(want)


def test_texts_under_one_key_stay(spark, monkeypatch):
    """With a key that many texts share no text is lost that has no copy."""
    monkeypatch.setattr(simhash, "text_key", lambda text: F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(3)))
    texts = [" ".join(f"t{g}w{i}" for i in range(80)) for g in range(12)]
    rows = [(d, texts[d % 12]) for d in range(30)]
    got = simhash.keep_dissimilar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == rows[:12]
