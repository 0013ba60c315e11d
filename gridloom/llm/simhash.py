"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: pairs of words of the perfect binary Golay code of 23 bits, one for each of
two stretches of the fingerprint; every 23-bit value has one code word within the covering radius 3. A fingerprint is
copied to every anchor within covering radius plus its share of the threshold. Of two fingerprints at most t bits apart
a third lies between them, at most floor(t/2) from one and ceil(t/2) from the other, and its anchor (radius 3 in each
stretch) is within the radius plus these distances of both; so ceil(t/2) beyond the radius suffices, counted over both
stretches, and the pair meets at that anchor. Fingerprints of an anchor are compared exactly, over all 64 bits.

Equal fingerprints are one before they are copied. In an anchor, links are followed from one fingerprint to all not yet
reached, so a group of n alike gives n - 1 links, not n squared. Links are joined to components by alternating large and
small stars over DataFrames. Null texts have the fingerprint zero; a null id is never a component's smallest unless it
has no other (the component is then null).

``similar`` groups by the Jaccard similarity of shingles instead; see there.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SEED, cut, drop_path, free_names, map_arrow, mix

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the Golay code of 23 bits.
GENERATOR, BITS, RADIUS = 0b101011100011, 23, 3
MASK = (1 << BITS) - 1


def shingle_hashes(body: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence where there are fewer words; none without words."""
    words = body.lower().split()
    if not words:
        return np.empty(0, "<u8")
    text = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(text, 42)], "<u8")
    size = np.cumsum([0, *map(len, words)])
    start = size[:-1] + np.arange(len(words))
    stop = start[shingle - 1 :] + [len(w) for w in words[shingle - 1 :]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], 42) for a, b in zip(start.tolist(), stop.tolist(), strict=False)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n, total = len(hashes), np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        total += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprint(body: bytes, shingle: int = 3) -> int:
    return majority(shingle_hashes(body, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long): a row per row."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(b or b"", shingle) for b in batch.column("body").to_pylist()], np.uint64)
            yield {"doc_id": batch.column("doc_id"), "fp": fps.view(np.int64)}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body")), run, "doc_id long, fp long")


def syndrome(x: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit values by the generator polynomial."""
    x = x.copy()
    for i in range(BITS - 1, 10, -1):
        x ^= ((x >> i) & 1) * (GENERATOR << (i - 11))
    return x


class Cover:
    """For each syndrome the error patterns of weight up to RADIUS + extra, by how far they go beyond RADIUS."""

    def __init__(self, extra: int):
        self.extra = extra
        self.levels = []  # per excess: patterns sorted by syndrome, first index by syndrome
        patterns = [[] for _ in range(extra + 1)]
        for weight in range(RADIUS + extra + 1):
            for places in combinations(range(BITS), weight):
                patterns[max(0, weight - RADIUS)].append(sum(1 << p for p in places))
        for level in patterns:
            e = np.array(level, np.int64)
            s = syndrome(e)
            order = np.argsort(s, kind="stable")
            self.levels.append((e[order], np.searchsorted(s[order], np.arange((1 << 11) + 1))))

    def _words(self, x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into x, code word) of all code words at that excess."""
        e, first = self.levels[level]
        s = syndrome(x)
        n = first[s + 1] - first[s]
        at = np.repeat(np.arange(len(x)), n)
        within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return at, x[at] ^ e[first[s][at] + within]

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into fps, anchor) of all anchors within reach."""
        x = fps.view(np.uint64)
        a, b = (x & np.uint64(MASK)).astype(np.int64), ((x >> np.uint64(BITS)) & np.uint64(MASK)).astype(np.int64)
        who, what = [], []
        left = [self._words(a, i) for i in range(self.extra + 1)]
        for i, (at, word) in enumerate(left):
            for j in range(self.extra + 1 - i):
                again, other = self._words(b[at], j)
                who.append(at[again])
                what.append((word[again] << BITS) | other)
        return np.concatenate(who), np.concatenate(what)


def links_within(fps: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that join all fingerprints of distinct values at most ``threshold`` bits apart, directly or by others."""
    left, out = fps.copy(), []
    while len(left):
        seen, left = [left[0]], left[1:]
        while seen and len(left):
            x = seen.pop()
            near = np.bitwise_count(left ^ x) <= threshold
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                seen += list(found)
                left = left[~near]
    return out


def _linked(threshold: int):
    def solved(anchor: np.ndarray, fps: np.ndarray):
        n = len(fps)
        if n < 2:
            return None
        edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(edge, n))
        a, b = [], []
        little = np.repeat(size <= 8, size)
        for lag in range(1, 8):
            i = np.flatnonzero(little[:-lag] & (anchor[:-lag] == anchor[lag:])) if n > lag else np.empty(0, int)
            if not len(i):
                break
            i = i[np.bitwise_count(fps[i] ^ fps[i + lag]) <= threshold]
            a.append(fps[i])
            b.append(fps[i + lag])
        for s, m in zip(edge[size > 8], size[size > 8], strict=True):
            if found := links_within(fps[s : s + m], threshold):
                pair = np.array(found, np.uint64)
                a.append(pair[:, 0])
                b.append(pair[:, 1])
        if not a:
            return None
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return {"a": pairs[0], "b": pairs[1]}

    def run(batches):
        anchor, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            anchor = np.concatenate([anchor, batch.column("anchor").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
            if out := solved(anchor[:whole], fps[:whole]) if whole else None:
                yield out
            anchor, fps = anchor[whole:], fps[whole:]
        if out := solved(anchor, fps):
            yield out

    return run


def links(fps: DataFrame, threshold: int = 3) -> DataFrame:
    """fps: distinct ``fp``. (a, b): links of at most ``threshold`` bits, enough to join all that are linked."""
    extra = -(-threshold // 2)

    def spread(batches):
        cover = Cover(extra)
        for batch in batches:
            x = batch.column("fp").to_numpy()
            for lo in range(0, len(x), 4096):
                part = x[lo : lo + 4096]
                at, anchor = cover.anchors(part)
                yield {"anchor": anchor, "fp": part[at]}

    copies = map_arrow(fps.select("fp").repartition("fp"), spread, "anchor long, fp long")
    return map_arrow(copies.repartition("anchor").sortWithinPartitions("anchor"), _linked(threshold), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. (node, root) for every node of an edge, root the smallest node reachable."""
    spark = edges.sparkSession
    now, path = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:  # each round halves the paths, so it ends after about log2 of the longest
        # large star: each node sends its greater neighbours to its smallest neighbour (or itself)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        # small star: each node sends its smaller neighbours and itself to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b")).where("a != b").distinct()
        then, new = cut(small, "links")
        seen = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_path(spark, path)
        now, path = then, new
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _grouped(fps: DataFrame, owners: DataFrame, edges: DataFrame) -> DataFrame:
    """fps with component_id; owners: each fingerprint's smallest id (``first``)."""
    owned = owners.select("fp", "first").join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(owned.join(least, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest id of the documents reachable over links): a row per row."""
    fps, _ = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    owners, _ = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "owners")
    return _grouped(fps, owners, links(owners, threshold))


# --- a similarity instead of a few bits ----------------------------------------------------------------
#
# Fingerprints only say which pairs to look at; a link is made where the Jaccard similarity of the distinct shingles, taken
# from the texts, reaches the threshold. Texts are looked at together if they share a shingle of their prefixes: of n distinct
# shingles in the order of their hashes the first n - ceil(s n) + 1. Two sets of similarity s or more share one without fail:
# at least ceil(s n) of a set's shingles are common, so the least common one is in both prefixes. Of the texts under a shingle,
# those whose wide fingerprints differ in at most ``bit_limit`` bits are joined to candidate groups, which are solved exactly.

#: Words of 64 bits in a wide fingerprint.
WORDS = 3
#: Fixed values that tell the hashes of a wide fingerprint's words apart.
SALTS = np.array([0, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Standard deviations that the bit limit of candidates lies above what the similarity leads one to expect.
DEVIATIONS = 5


def bit_limit(similarity: float) -> int:
    """Differing bits up to which texts are candidates: what a Jaccard similarity leads one to expect by the angle (sets of
    equal size differ most), and DEVIATIONS standard deviations more, so that hardly any similar pair is beyond."""
    bits = 64 * WORDS
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))


def shingle_set(body: bytes, shingle: int) -> np.ndarray:
    """Distinct shingle hashes in ascending order; texts without words are alike and have the one value 0."""
    hashes = np.unique(shingle_hashes(body, shingle))
    return hashes if len(hashes) else np.zeros(1, np.uint64)


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1


def text_key(text: Column) -> Column:
    """64 bits that stand for a text (null: empty)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def second_key(text: Column) -> Column:
    return F.xxhash64(F.lit(SEED), F.coalesce(text, F.lit("")))


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """doc_id, key (of the text), w0.. (the words of the fingerprint), prefix (of the shingles): a row per row."""
    names = [f"w{i}" for i in range(WORDS)]

    def run(batches):
        for batch in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
            fps, prefixes = [], []
            for body in batch.column("body").to_pylist():
                own = shingle_set(body or b"", shingle)
                fps.append([majority(mix(own ^ SALTS[i]) if i else own) for i in range(WORDS)])
                prefixes.append(own[: prefix_size(len(own), similarity)].view(np.int64).copy())
            words = np.array(fps, np.uint64).reshape(-1, WORDS)
            out = {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "prefix": prefixes}
            yield out | {n: words[:, i].copy().view(np.int64) for i, n in enumerate(names)}

    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("binary").alias("body"))
    return map_arrow(body, run, "doc_id long, key long, prefix array<long>, " + ", ".join(f"{n} long" for n in names))


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


#: Fingerprints that one task joins to trees before it hands them on.
FOREST_NODES = 1 << 18


class Trees:
    """Links as trees whose roots are their smallest nodes: n linked fingerprints leave n - 1 links, however many shingles they share."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (above := up.setdefault(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up[x]
        return top

    def add(self, pairs: np.ndarray) -> None:
        """pairs: two rows of linked nodes."""
        for x, y in zip(*pairs.tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def edges(self) -> dict[str, np.ndarray]:
        pairs = [(top, x) for x in self.up if (top := self.root(x)) != x]
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        return {"a": a, "b": b}


def _linked_wide(limit: int):
    names = [f"w{i}" for i in range(WORDS)]

    def followed(words: np.ndarray) -> list[tuple[int, int]]:
        """Links by place that join all under a shingle that are linked, directly or by others."""
        left, out = np.arange(1, len(words)), []
        seen, here = [0], 0
        while len(left):
            if not seen:
                seen, left = [left[0]], left[1:]
            here = seen.pop()
            near = _far(words[left], words[here]) <= limit
            found, left = left[near], left[~near]
            out += [(here, x) for x in found.tolist()]
            seen += found.tolist()
        return out

    def solved(anchor, fp, words):
        edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(edge, len(anchor)))
        little = np.repeat(size <= 8, size)
        a, b = [], []
        for lag in range(1, min(8, len(anchor))):
            i = np.flatnonzero(little[:-lag] & (anchor[:-lag] == anchor[lag:]))
            i = i[_far(words[i], words[i + lag]) <= limit]
            a.append(i)
            b.append(i + lag)
        for s, m in zip(edge[size > 8], size[size > 8], strict=True):
            if found := followed(words[s : s + m]):
                pair = np.array(found) + s
                a.append(pair[:, 0])
                b.append(pair[:, 1])
        if not a:
            return np.empty((2, 0), np.int64)
        a, b = fp[np.concatenate(a)], fp[np.concatenate(b)]
        return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)

    def run(batches):
        held, trees = None, Trees()
        for batch in batches:
            now = [batch.column(n).to_numpy() for n in ("token", "key", *names)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if whole:
                trees.add(solved(held[0][:whole], held[1][:whole], np.stack(held[2:], axis=1)[:whole].view(np.uint64)))
                held = [x[whole:] for x in held]
            if len(trees.up) > FOREST_NODES:
                yield trees.edges()
                trees = Trees()
        if held is not None and len(held[0]) > 1:
            trees.add(solved(held[0], held[1], np.stack(held[2:], axis=1).view(np.uint64)))
        if trees.up:
            yield trees.edges()

    return run


def candidate_links(owners: DataFrame, limit: int) -> DataFrame:
    """owners: distinct key with its words and prefix. (a, b): enough links to join keys of at most ``limit`` bits that share a prefix shingle."""
    names = [f"w{i}" for i in range(WORDS)]
    copies = owners.select(F.explode("prefix").alias("token"), "key", *names)
    return map_arrow(copies.repartition("token").sortWithinPartitions("token"), _linked_wide(limit), "a long, b long").distinct()


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each of the sets (distinct values) the place of the first set that it is joined to by pairs of at least that Jaccard similarity.

    Values are ordered from rare to frequent, so that prefixes meet seldom; sets that share a prefix value are compared whole.
    A set already reached isn't compared again.
    """
    size = np.array([len(x) for x in sets])
    values, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(values))
    rows = [np.sort(x) for x in np.split(rank[ids], np.cumsum(size)[:-1])]
    prefix = [x[: prefix_size(len(x), similarity)] for x in rows]
    flat, owner = np.concatenate(prefix), np.repeat(np.arange(len(sets)), [len(x) for x in prefix])
    order = np.argsort(flat, kind="stable")
    owner, first = owner[order], np.searchsorted(flat[order], np.arange(len(values) + 1))
    left, label, mark = np.ones(len(sets), bool), np.arange(len(sets)), np.zeros(len(values), np.int64)
    for start in range(len(sets)):
        if not left[start]:
            continue
        left[start], seen = False, [start]
        while seen:
            x = seen.pop()
            near = np.concatenate([owner[first[v] : first[v + 1]] for v in prefix[x].tolist()])
            near = np.unique(near[left[near]])
            if not len(near):
                continue
            mark[rows[x]] = 1
            common = np.add.reduceat(mark[np.concatenate([rows[y] for y in near.tolist()])], np.concatenate([[0], np.cumsum(size[near])[:-1]]))
            mark[rows[x]] = 0
            near = near[common * (1 + similarity) >= similarity * (size[x] + size[near]) - 1e-9]
            left[near], label[near] = False, start
            seen += near.tolist()
    return label


def _verified(shingle: int, similarity: float):
    def solved(members: dict[int, bytes]):
        keys = np.array(sorted(members), np.int64)
        label = alike([shingle_set(members[k], shingle) for k in keys.tolist()], similarity)
        return {"key": keys, "root": keys[label]}

    def run(batches):
        group, members = None, {}
        for batch in batches:
            for g, k, body in zip(*(batch.column(c).to_pylist() for c in ("grp", "key", "body")), strict=True):
                if g != group:
                    if members:
                        yield solved(members)
                    group, members = g, {}
                members[k] = body or b""
        if members:
            yield solved(members)

    return run


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, key (of the text), root, component_id (the smallest id of the component): a row per row. Rows of one root are
    joined by pairs of texts whose distinct shingles have at least that Jaccard similarity."""
    wide, _ = cut(wide_fingerprints(docs, id_col, text_col, shingle, similarity), "fingerprints")
    some = [F.first(c).alias(c) for c in ("prefix", *(f"w{i}" for i in range(WORDS)))]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    owners, _ = cut(wide.groupBy("key").agg(first, *some), "owners")
    groups = components(candidate_links(owners, bit_limit(similarity))).withColumnRenamed("node", "key").withColumnRenamed("root", "grp")
    wanted = owners.join(groups, "key").select(F.col("first.doc_id").alias("_d"), F.col("key").alias("_k"), "grp")
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("binary").alias("body"))
    found = found.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).select("grp", "key", "body")
    roots, _ = cut(map_arrow(found.repartition("grp").sortWithinPartitions("grp"), _verified(shingle, similarity), "key long, root long"), "roots")
    owned = owners.select("key", "first.doc_id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = owned.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return wide.select("doc_id", "key").join(owned.select("key", "root").join(least, "root"), "key")


def _kept(docs: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """roots: distinct key (of a text) with its component's root. One row of docs per root: that with the least id (null last), then
    key. Texts under one key are told apart by a second hash: the component is that of one of them, the others stay for themselves."""
    ids, key, more = F.col(id_col).cast("long"), text_key(F.col(text_col)), second_key(F.col(text_col))
    row = docs.select(ids.alias("_d"), key.alias("key"), more.alias("more"))
    least = row.groupBy("key", "more").agg(F.min(F.struct(F.col("_d").isNull().alias("none"), "_d")).alias("least"))
    own = least.groupBy("key").agg(F.min("more").alias("own"))
    apart = F.when(F.col("more") != F.col("own"), F.struct("key", "more"))
    rooted = least.join(own, "key").join(roots, "key").withColumn("apart", apart)
    first = rooted.groupBy("root", "apart").agg(F.min(F.struct("least.none", "least._d", "key", "more")).alias("f")).select("f.*")
    # the same columns for the join and for equal rows, so that texts are shuffled once
    names = free_names(docs, "none", "id", "key", "more")
    on = lambda d, *k: dict(zip(names, (d.isNull(), F.coalesce(d, F.lit(0)), *k), strict=True))
    keyed = docs.withColumns(on(ids, key, more))
    first = first.select(*(c.alias(n) for n, c in on(F.col("_d"), F.col("key"), F.col("more")).items()))
    return keyed.join(first, names, "left_semi").dropDuplicates(names).drop(*names)


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of ``near_duplicates``, that with the smallest id, with all columns of ``docs``."""
    by_text = docs.select(text_key(F.col(text_col)).alias("doc_id"), F.col(text_col).alias("text"))
    found = near_duplicates(by_text, **options)  # a text is in one component, so the least key names it
    return _kept(docs, found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("root")).distinct(), id_col, text_col)


def keep_dissimilar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of ``similar``, that with the smallest id, with all columns of ``docs``."""
    return _kept(docs, similar(docs, id_col, text_col, **options).select("key", "root").distinct(), id_col, text_col)
