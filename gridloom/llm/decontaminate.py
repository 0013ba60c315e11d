"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

Texts are split once into a stored table of words. ``postings`` writes (term, row, position) for the two rarest terms of
every ``window`` consecutive item words, rarity counted over all documents. ``phrase_matches`` shifts these postings by the
terms' places in the item and intersects them: a document and an alignment stay where both meet. There the words are
compared in full. ``proximity_matches`` gives pairs of those rarest terms within ``slop`` words of their distance.

Words: A-Z in lower case, maximal stretches of digits, letters a-z and characters beyond ASCII. Null texts have no
words. An item of fewer words than a window (but one) is a window. Items and documents may repeat ids; an item without id
counts for hits but isn't named. Documents of equal id and text get equal results. Texts may be of any length that Spark
holds; empty tables give empty results. Columns other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.llm.common import cut, free_names, row_key

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Bytes up to which a table of test terms is broadcast, counted as the terms' own and 64 a row; beyond, joins shuffle.
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_remove(F.split(low, SEPARATORS), "")


def small(df: DataFrame) -> DataFrame:
    """``df`` (with a column ``term``, of a stored table) with a broadcast hint if its measured size is within the bound."""
    size = df.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def test_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, iid (a number for the row), w (words), n; items without words are left out."""
    w = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    return cut(w.select("item", "w", F.size("w").alias("n"), F.monotonically_increasing_id().alias("iid")).hint("rebalance"), "items")[0]


def anchors(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(iid, q, term, need, n): the places of the two rarest terms of each window of an item of n words."""
    places = items.select("iid", "n", F.posexplode("w").alias("q", "term"))
    vocabulary = places.select("term").distinct()
    seen = docs.select(F.explode("w").alias("term")).join(small(vocabulary), "term").groupBy("term").agg(F.count("*").alias("df"))
    rated = places.join(seen, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    starts = F.sequence(F.greatest(F.lit(0), F.col("q") - window + 1), F.least(F.col("q"), F.greatest(F.lit(0), F.col("n") - window)))
    rarest = W.partitionBy("iid", "o").orderBy("df", "q")
    chosen = rated.withColumn("o", F.explode(starts)).withColumn("r", F.row_number().over(rarest))
    # a window with a term of no document has no match
    least = chosen.withColumn("least", F.min("df").over(W.partitionBy("iid", "o"))).where("r <= 2 and least > 0")
    return cut(least.select("iid", "q", "term", F.least(F.lit(2), "n").alias("need"), "n").distinct().hint("rebalance"), "anchors")[0]


@dataclass(frozen=True)
class Index:
    """The stored words of all documents (``r1, r2, w``), the items, the anchors' places and their stored postings."""

    docs: DataFrame
    items: DataFrame
    places: DataFrame
    postings: DataFrame

    def shifted(self) -> DataFrame:
        """A row per posting and place of its term in an item: where the item's word 0 would be."""
        both = self.postings.join(small(self.places), "term")
        return both.select("r1", "r2", "iid", "q", "pos", (F.col("pos") - F.col("q")).alias("at"), "need", "n")


def index(docs: DataFrame, items: DataFrame, window: int = 10) -> Index:
    """docs: r1, r2, w, stored; items: of ``test_items``."""
    places = anchors(docs, items, window)
    terms = places.select("term").distinct()
    each = docs.select("r1", "r2", F.posexplode("w").alias("pos", "term"))
    return Index(docs, items, places, cut(each.join(small(terms), "term"), "postings")[0])


def phrase_matches(found: Index, window: int = 10) -> DataFrame:
    """(r1, r2, item, iid, start, len): every occurrence of a window."""
    met = found.shifted().groupBy("r1", "r2", "iid", "at").agg(F.count("*").alias("m"), F.max("need").alias("need"), F.max("n").alias("n"))
    wanted, _ = cut(met.where("m >= need").drop("m", "need"), "alignments")
    keys = wanted.select("r1", "r2").distinct()
    if 32 * wanted.count() <= BROADCAST_BYTES:  # a key's 16 bytes and as many about it
        keys = F.broadcast(keys)
    near = found.docs.join(keys, ["r1", "r2"], "left_semi").withColumnRenamed("w", "w_doc")
    a = F.greatest(F.col("at"), F.lit(0))
    b = F.least(F.col("at") + F.col("n"), F.size("w_doc"))
    # the stretch of an alignment is cut out first, so that no whole text goes with it
    pairs = wanted.join(near, ["r1", "r2"]).withColumn("a", a).withColumn("b", b).where("b > a")
    pairs = pairs.select("r1", "r2", "iid", "n", "at", "a", F.slice("w_doc", F.col("a") + 1, F.col("b") - F.col("a")).alias("there")).join(found.items.select("iid", "item", "w"), "iid")
    pairs = pairs.withColumn("same", F.zip_with("there", F.slice("w", F.col("a") - F.col("at") + 1, F.size("there")), lambda x, y: x.eqNullSafe(y)))
    size = F.least(F.col("n"), F.lit(window))
    last = F.size("same") - size
    hits = F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda o: F.forall(F.slice(F.col("same"), o + 1, size), lambda x: x)))
    return pairs.withColumn("len", size).withColumn("o", F.explode(hits)).select("r1", "r2", "item", "iid", (F.col("a") + F.col("o")).alias("start"), "len")


def proximity_matches(found: Index, slop: int = 5) -> DataFrame:
    """(r1, r2, iid, first, last): two anchor terms of an item whose distance in the text is within ``slop`` words of that in
    the item, next to each other in the order of their alignments."""
    order = W.partitionBy("r1", "r2", "iid").orderBy("at", "q")
    near = found.shifted().withColumn("at2", F.lead("at").over(order)).withColumn("pos2", F.lead("pos").over(order)).withColumn("q2", F.lead("q").over(order))
    near = near.where((F.col("at2") - F.col("at") <= slop) & (F.col("q") != F.col("q2")))
    return near.select("r1", "r2", "iid", F.least("pos", "pos2").alias("first"), F.greatest("pos", "pos2").alias("last")).distinct()


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, r1, r2 (the row's key), w (its words): stored, so that texts are split once."""
    r1, r2 = row_key(F.col(id_col), F.col(text_col))
    return cut(docs.select(F.col(id_col).alias("doc_id"), r1.alias("r1"), r2.alias("r2"), words(F.col(text_col)).alias("w")), "words")[0]


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, slop: int | None = None
) -> DataFrame:
    """A row per row of ``docs``: doc_id, r1, r2, n_words, n_hit (words in windows), n_items, items (sorted ids, as strings) and
    with ``slop`` n_near (pairs of anchor terms in proximity)."""
    tokens = tokenised(docs, id_col, text_col)
    found = index(tokens.select("r1", "r2", "w"), test_items(items, item_col, item_text_col), window)
    matches, _ = cut(phrase_matches(found, window), "matches")
    spans = matches.select("r1", "r2", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = F.max("end").over(W.partitionBy("r1", "r2").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))))
    hit = spans.withColumn("fresh", fresh).groupBy("r1", "r2").agg(F.sum("fresh").alias("n_hit"))
    named = matches.where("item is not null").select("r1", "r2", "item").distinct()
    named = named.groupBy("r1", "r2").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("items"))
    rows = tokens.select("doc_id", "r1", "r2", F.size("w").cast("long").alias("n_words")).join(hit, ["r1", "r2"], "left").join(named, ["r1", "r2"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    cols = ["doc_id", "r1", "r2", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items")]
    if slop is not None:
        rows = rows.join(proximity_matches(found, slop).groupBy("r1", "r2").agg(F.count("*").alias("n_near")), ["r1", "r2"], "left")
        cols.append(zero("n_near"))
    return rows.select(*cols)


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with all columns; only whether there is one is asked for, so that
    matches aren't stored."""
    a, b = free_names(docs, "r1", "r2")
    tokens = tokenised(docs, id_col, text_col).select("r1", "r2", "w")
    matches = phrase_matches(index(tokens, test_items(items, item_col, item_text_col), window), window)
    found = matches.select(F.col("r1").alias(a), F.col("r2").alias(b)).distinct()
    r1, r2 = row_key(F.col(id_col), F.col(text_col))
    return docs.withColumns({a: r1, b: r2}).join(found, [a, b], "left_anti").drop(a, b)
