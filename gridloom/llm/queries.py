"""The corpus operators' queries over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import classifier, decontaminate, hard_negatives, license_scan, line_dedup, packing, quality_rules, sharding, simhash, substring_dedup, suffix_dedup, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = sharding.interleave(slim, 16, "source", ("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rate_documents(table(spark, sf_dir, "documents")).drop("rejected_by")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op3_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of lines that an earlier place has; ``op3_line_dedup`` finds those that its chunk boundaries show."""
    return line_dedup.line_run_report(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_suffixes(table(spark, sf_dir, "documents"), digest=True)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=5)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), digest=True)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages")).drop("url")


def op9_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"))
    each = got.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", "at").alias("explained"), "identity_error")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    noisy = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(noisy, F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_quality_rules, op3_line_dedup, op3_line_runs, op4_suffix_dedup, op5_decontamination, op6_substring_dedup, op7_packing, op8_warc, op9_classifier, op10_simhash, op11_whitening, op12_license_scan, op13_hard_negatives)
}

SPACE = "[\\x20\\x09-\\x0D]"
OP2 = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{SPACE}+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT k, count(DISTINCT i + o) AS n_repeat_words FROM (SELECT *, count(*) OVER (PARTITION BY k, g) AS c FROM g), (VALUES (0), (1), (2)) AS v(o) WHERE c > 1 GROUP BY k),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS lines,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters,
  (length(t) - length(replace(t, '!!', ''))) // 2 AS bangs FROM w LEFT JOIN r USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > 0.1::DOUBLE * n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR n_dup_lines > 0.4::DOUBLE * lines
    OR (n_letters > 20 AND n_upper > 0.5::DOUBLE * n_letters) OR bangs > 0.2::DOUBLE * n_words) AS kept FROM b"""

TERMS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP5 = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {TERMS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, w, len(w) AS n, least(10, len(w)) AS z FROM (SELECT item_id, {TERMS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT iid, item_id, z, o, array_to_string(w[o:o + z - 1], ' ') AS g FROM (SELECT *, unnest(range(1, n - z + 2)) AS o FROM i)),
dw AS (SELECT k, z, o, array_to_string(w[o:o + z - 1], ' ') AS g FROM (SELECT k, w, z, unnest(range(1, len(w) - z + 2)) AS o FROM d, (SELECT DISTINCT z FROM i))),
m AS (SELECT k, item_id, dw.z, dw.o FROM dw JOIN (SELECT DISTINCT item_id, z, g FROM iw) x ON dw.z = x.z AND dw.g = x.g),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(o, o + z)) AS p FROM m) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY k),
dt AS (SELECT k, w[p] AS term, p - 1 AS pos FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
f AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
c AS (SELECT iid, o, q, w[o + q] AS term, coalesce(df, 0) AS df FROM (SELECT iid, w, o, unnest(range(0, z)) AS q FROM (SELECT iid, w, z, unnest(range(1, n - z + 2)) AS o FROM i)) LEFT JOIN f ON f.term = w[o + q]),
a AS (SELECT DISTINCT iid, o + q - 1 AS q, term FROM (SELECT *, row_number() OVER (PARTITION BY iid, o ORDER BY df, q) AS r, min(df) OVER (PARTITION BY iid, o) AS least FROM c) WHERE r <= 2 AND least > 0),
s AS (SELECT k, iid, q, pos, pos - q AS al FROM dt JOIN a USING (term)),
near AS (SELECT k, count(*) AS n_near FROM (SELECT DISTINCT k, iid, least(pos, pos2) AS lo, greatest(pos, pos2) AS hi FROM (SELECT *, lead(al) OVER x AS al2, lead(pos) OVER x AS pos2, lead(q) OVER x AS q2 FROM s WINDOW x AS (PARTITION BY k, iid ORDER BY al, q)) WHERE al2 - al <= 5 AND q <> q2) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k) LEFT JOIN near USING (k)"""

OP8 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), s AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""

WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '')"
OP4 = """WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT k, i, md5(substr(x, 2 * i + 1, 400)) AS g FROM (SELECT k, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM d)),
r AS (SELECT k, i, i - lag(i) OVER (PARTITION BY k ORDER BY i) AS step FROM (SELECT k, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
s AS (SELECT k, min(i) AS a, max(i) + 200 AS b FROM (SELECT k, i, sum(CASE WHEN step <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run FROM r) GROUP BY k, run),
p AS (SELECT k, a, b, lag(b, 1, 0) OVER (PARTITION BY k ORDER BY a) AS z FROM s),
c AS (SELECT k, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS x, max(b) AS z, sum(b - a) AS gone, count(*) AS n FROM p JOIN d USING (k) GROUP BY k)
SELECT doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(c.x, '') || substr(d.x, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c USING (k)"""
OP6 = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {WORDS} AS w FROM documents),
g AS (SELECT k, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
r AS (SELECT k, i FROM (SELECT k, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM g) WHERE least < doc_id),
c AS (SELECT DISTINCT k, p FROM (SELECT k, unnest(range(i, i + 50)) AS p FROM r)),
l AS (SELECT k, p, w[p] AS word FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
s AS (SELECT k, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM l ANTI JOIN c USING (k, p) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (k)"""



def license_sql() -> str:
    """Every template against every block, as lists of words."""
    text = lambda v: "'" + v.replace("'", "''") + "'"
    words = lambda ws: "[" + ", ".join(map(text, ws)) + "]"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = "list_distinct(list_filter(string_split_regex({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> ''))"
    templates = ", ".join(f"({text(t.unit)}, {text(t.label)}, {len(t.words)}, {license_scan.needed(t)}, {words(t.words)})" for t in license_scan.TEMPLATES)
    phrases = ", ".join(f"({text(label)}, {words(p.split())})" for p, label in license_scan.PHRASES.items())
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {TERMS} AS w, {low} AS t FROM documents),
t(unit, label, n, need, words) AS (VALUES {templates}), p(label, words) AS (VALUES {phrases}),
par AS (SELECT k, unnest(string_split_regex(t, '{license_scan.BORDER}')) AS b FROM d),
b AS (SELECT k, 'paragraph' AS unit, {split.format("b")} AS b FROM par UNION ALL SELECT k, 'line', {split.format("l")} FROM (SELECT k, unnest(string_split(b, chr(10))) AS l FROM par)),
m AS (SELECT k, label, len(list_intersect(b, words))::DOUBLE / n AS held FROM b JOIN t USING (unit) WHERE len(b) >= need AND len(list_intersect(b, words)) >= need),
h AS (SELECT k, label, i - 1 AS place FROM (SELECT k, label, w, words, unnest(range(1, len(w) - len(words) + 2)) AS i FROM d, p WHERE list_has_all(w, words)) WHERE w[i:i + len(words) - 1] = words),
c AS (SELECT k, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM h GROUP BY k),
l AS (SELECT k, string_agg(label, ',' ORDER BY label) AS labels, string_agg(label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, max(held) AS held
  FROM (SELECT k, label, max(held) AS held, bool_or(base) AS base FROM (SELECT k, label, 1.0::DOUBLE AS held, true AS base FROM h UNION ALL SELECT k, label, held, false FROM m) GROUP BY k, label) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(held, 0.0::DOUBLE) AS score FROM d LEFT JOIN c USING (k) LEFT JOIN l USING (k)"""


OP13 = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, s AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, id AS negative_id, positive_score, s AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s DESC, id) QUALIFY rank <= 3"""

#: The same in DuckDB's SQL, for whole tables. op1, op3, op7 and op10 need hashes or a tokenizer that it lacks, op9 a fit, op11
#: eigenvectors; these are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op12_license_scan": license_sql(), "op13_hard_negatives": OP13, "op2_quality_rules": OP2, "op4_suffix_dedup": OP4, "op5_decontamination": OP5, "op6_substring_dedup": OP6, "op8_warc": OP8}
