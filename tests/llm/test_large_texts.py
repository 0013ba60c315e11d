"""Texts of over a megabyte through the operators and the pipeline's stages; placements and chunk boundaries by versions of their own."""

import random

import pytest

from gridloom.llm import classifier, decontaminate, line_dedup, packing, quality_rules, simhash, warc

from . import brute
from .test_operators import check_packing, same

WORDS = random.Random(9)
LONG = "\n".join(" ".join(f"w{WORDS.randrange(5000)}" for _ in range(12)) for _ in range(18_000))
PASSAGE = " ".join(f"exam{i}" for i in range(30))
TEXTS = [(1, LONG), (2, LONG[: len(LONG) // 2] + "\n" + PASSAGE + "\n" + LONG[len(LONG) // 2 :]), (3, "short text of few words"), (4, PASSAGE), (5, "x" * 1_300_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", "src1", len(t)) for d, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).cache()


def test_sizes():
    assert min(len(TEXTS[k][1]) for k in (0, 1, 4)) > 1 << 20


def test_rules(docs):
    same(quality_rules.rate_documents(docs), "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed", brute.rules(TEXTS))
    assert {r.doc_id for r in quality_rules.keep_by_rules(docs).collect()} == {r.doc_id for r in quality_rules.rate_documents(docs).where("kept").collect()}


def test_lines(docs):
    """The second text keeps its passage and loses what the first has, but for what borders it."""
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert kept[1] == LONG and PASSAGE in kept[2] and len(kept[2]) < 2000 and kept[5] == TEXTS[4][1]
    report = {r.doc_id: r for r in line_dedup.line_report(docs).collect()}
    assert report[1].n_removed_lines == 0 and report[2].n_removed_lines > 0.6 * report[2].n_lines


def test_contamination(spark, docs):
    items = [(1, PASSAGE), (2, " ".join(LONG.split()[-10:]))]
    found = decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, brute.sha(",".join(r["items"])), r.n_hit > 0) for r in found.collect()]
    assert sorted(got) == sorted(brute.contamination(TEXTS, items))
    assert [r.doc_id for r in decontaminate.decontaminated(docs, spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()] == [3, 5]


def test_packing(docs):
    check_packing(packing.pack_documents(docs.where("doc_id in (2, 3)"), __import__("gridloom.llm.queries", fromlist=["queries"]).tokenizer_path()).toPandas(), [TEXTS[1], TEXTS[2]])


def test_fingerprints_and_near_copies(docs):
    got = simhash.near_duplicates(docs)
    same(got.selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) as f", "component_id"), "doc_id f component_id", brute.simhash(TEXTS))
    assert {r.doc_id for r in simhash.keep_dissimilar(docs).collect()} == {1, 3, 4, 5}


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert sorted(r.doc_id for r in classifier.rate(docs, labels).collect()) == [1, 2, 3, 4, 5]


def test_archives(spark):
    pages = [(1, "http://a", LONG), (2, "http://b", LONG), (3, "http://c", "small")]
    got = {r.page_id: r for r in warc.archive_round_trip(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1].payload_bytes == len(LONG) and got[1].payload_digest == brute.sha(LONG.encode()) and (got[2].record_type, got[2].refers_to) == ("revisit", 1)


def placed(lengths, size, most):
    """Best fit with a list of open bins: the least free space that fits, the oldest of equals; the fullest closes first."""
    bins, number, out, turn = [], 0, [], 0
    for n in lengths:
        fitting = [b for b in bins if b["free"] >= n]
        if fitting:
            b = min(fitting, key=lambda b: (b["free"], b["since"]))
        else:
            b = {"id": number, "free": size, "since": 0}
            bins.append(b)
            number += 1
        out.append((b["id"], size - b["free"]))
        turn += 1
        b["free"], b["since"] = b["free"] - n, turn
        if not b["free"]:
            bins.remove(b)
        elif len(bins) > most:
            bins.remove(min(bins, key=lambda b: (b["free"], b["since"])))
    return out


@pytest.mark.parametrize("size,most,least", [(100, 8, 1), (100, 3, 30), (4096, 16, 1), (50, 1, 10), (20, 1000, 1)])
def test_placements_by_a_list_of_bins(size, most, least):
    rng = random.Random(size + most)
    lengths = [rng.randint(least, size) if rng.random() < 0.8 else size for _ in range(1500)]
    assert list(packing.best_fit(lengths, size, most)) == placed(lengths, size, most)


def test_boundaries_shift_with_their_lines():
    """A boundary follows from the lines before it alone: lines put in front move it along, and nothing behind it changes."""
    rng = random.Random(4)
    lines = [f"line {rng.random()}\n" for _ in range(600)]
    chunks = lambda ls: [tuple(ls[i : i + n]) for i, n in _starts(ls)]

    def _starts(ls):
        at = 0
        for _, _, n in line_dedup.chunk_spans("".join(ls).encode()):
            yield at, n
            at += n

    plain = chunks(lines)
    assert sum(map(len, plain)) == 600 and 2.5 < 600 / len(plain) < 7  # a boundary every four lines on average
    for where in (0, 1, 200):
        moved = chunks(lines[:where] + ["new one\n", "another\n"] + lines[where:])
        same_ = set(plain) & set(moved)
        assert len(set(plain) - same_) <= 2  # only the chunks around the place differ
    long = [f"x{rng.random()}\n" for _ in range(300)]
    spans = line_dedup.chunk_spans("".join(long).encode(), mean=1 << 40)  # no boundary by hash: sixty-four lines end a chunk
    assert [n for *_, n in spans] == [64, 64, 64, 64, 44]
    inserted = line_dedup.chunk_spans("".join(long[:10] + ["new\n"] + long[10:]).encode(), mean=1 << 40)
    assert [n for *_, n in inserted] == [64, 64, 64, 64, 45]
