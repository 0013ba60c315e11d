"""Best-fit packing of token sequences with bounded space.

Pieces arrive one after the other (seeded order, so lengths are mixed). Open bins are held by their free space, and a
bitset has a bit for each free space that some bin has: the lowest set bit at or above a piece's length is the best
fit. With ``open_bins`` bins open a new one closes the fullest, the lowest bit of all.

Pieces are dealt to groups of about ``group_rows`` by a hash, and each group is packed by itself; a group's bins stay
its own. Only documents longer than a sequence are cut. Null texts are empty; they have the end token only. Rows with equal
id and text are pieces of their own, null ids stay null. A text of any length is tokenised whole; an empty table gives none.

Tokens are the tokenizer's own. Where its file has the layout of ``LAYOUT`` (text in lower case, cut at white space, into
letters, single digits and the rest, with a token that ends every part), distinct words are split into these parts and
only distinct parts are handed to it; a word with other characters goes to it whole, and with another layout whole texts do.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import hand_back, handing_back, map_arrow, small_batches

SEQUENCE = 4096
END = 1
#: Bytes of text that are tokenised together.
SLICE = 2 << 20
#: What a tokenizer's file says where its words can be taken apart as here.
LAYOUT = {
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
    "end_of_word_suffix": "</w>",
}
#: Parts of lower-case words of ASCII and the letters U+00C0 to U+00FF, whose composed form is their own.
PARTS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\na-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
PLAIN = "^[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"


class TextIds:
    """texts -> token ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocabulary = told["model"]["vocab"]
        pre = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_parts = (
            (told.get("normalizer") or {}).get("normalizers") == LAYOUT["normalizers"] and pre[0].get("pattern") == {"Regex": LAYOUT["split"]}
            and told["model"].get("end_of_word_suffix") == LAYOUT["end_of_word_suffix"]
        )
        self.marks = tuple(x["content"] for x in told.get("added_tokens", ()))
        if self.by_parts:
            # parts have no white space and are in lower case: nothing else is to be cut or changed
            self.parts = Tokenizer(self.tokenizer.model)
            self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(1 + max(vocabulary.values()), bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(LAYOUT["end_of_word_suffix"])]] = True

    def _of(self, tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has)."""
        ids = self._of(self.tokenizer, texts)
        return np.concatenate([np.empty(0, "<u4"), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))

    def of_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        groups = [parts[lo : lo + 1000] for lo in range(0, len(parts), 1000)]
        ids, sizes = [], []
        for some, own in zip(groups, self._of(self.parts, [" ".join(g) for g in groups]), strict=True):
            size = np.diff(np.flatnonzero(self.ends[own]), prepend=-1)
            if len(size) != len(some):  # a token that ends a part within one
                own, size = self.whole(some)
            ids.append(own)
            sizes.append(size)
        return np.concatenate([np.empty(0, "<u4"), *ids]), np.concatenate([np.empty(0, np.int64), *sizes])

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of distinct words without white space."""
        plain = pc.match_substring_regex(words, PLAIN)
        for mark in self.marks:
            plain = pc.and_not(plain, pc.match_substring(words, mark))
        some, others = words.filter(plain), words.filter(pc.invert(plain)).to_pylist()
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), "\n")[0].as_py()
        parts = pa.array(PARTS.findall(line.lower()), pa.string()).dictionary_encode()
        distinct = parts.dictionary.to_pylist()
        flat, size = self.of_parts([p for p in distinct if p != "\n"])
        if "\n" in distinct:  # stands between words
            size = np.insert(size, distinct.index("\n"), 0)
        ids, each = spread(flat, size, parts.indices.to_numpy())
        more, more_sizes = self.whole(others)
        at = plain.to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(words), np.int64)
        if len(some):
            sizes[at] = np.diff(np.concatenate([[0], np.cumsum(each)[each == 0], [len(ids)]]))
        sizes[~at] = more_sizes
        own = np.repeat(at, sizes)
        out = np.empty(len(own), "<u4")
        out[own], out[~own] = ids, more
        return out, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each text's first place and the end); each distinct word is looked up once."""
        if not self.by_parts:
            ids, sizes = self.whole(texts.to_pylist())
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        words = pc.ascii_split_whitespace(texts)
        each = words.flatten().dictionary_encode()
        ids, n = spread(*self.of_words(each.dictionary), each.indices.to_numpy())
        offsets = words.offsets.to_numpy()
        return ids, np.concatenate([[0], np.cumsum(n)])[offsets - offsets[0]]


def spread(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``at`` of ``flat``, whose stretches have ``sizes``, one after the other, and their sizes."""
    first, n = (np.cumsum(sizes) - sizes)[at], sizes[at]
    end = np.cumsum(n)
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(first - (end - n), n)], n


_LOADED: dict[str, TextIds] = {}


def _ids(path: str) -> TextIds:
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each hold memory of their own
        _LOADED[path] = TextIds(path)
        hand_back()
    return _LOADED[path]


def best_fit(lengths: Iterable[int], size: int = SEQUENCE, open_bins: int = 1024) -> Iterator[tuple[int, int]]:
    """(bin, offset) of each length, in turn; bounded space."""
    bits, bins, number, held = 0, [deque() for _ in range(size + 1)], 0, 0
    for length in lengths:
        fits = bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = bins[free].popleft()
            if not bins[free]:
                bits ^= 1 << free
        else:
            free, b = size, number
            number += 1
            held += 1
        yield b, size - free
        free -= length
        if not free:
            held -= 1
            continue
        if not bins[free]:
            bits |= 1 << free
        bins[free].append(b)
        if held > open_bins:
            full = (bits & -bits).bit_length() - 1
            bins[full].popleft()
            if not bins[full]:
                bits ^= 1 << full
            held -= 1


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of about SLICE bytes of text, a row at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, side="right")))
        yield lo, hi
        lo = hi


def tokenised_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of every piece."""

    def run(batches):
        table = _ids(tokenizer)
        for batch in batches:
            given, bodies = batch.column("doc_id"), pc.fill_null(batch.column("body"), "")
            for lo, hi in _slices(bodies):
                ids, first = table.encode(bodies.slice(lo, hi - lo))
                out = {c: [] for c in ("at", "piece", "start", "length", "ids_crc32", "ids")}
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True), lo):
                    own = np.empty(b - a + 1, "<u4")
                    own[:-1], own[-1] = ids[a:b], END
                    for p, x in enumerate(range(0, len(own), size)):
                        part = own[x : x + size]
                        row = (i, p, x, len(part), zlib.crc32(part), part.view("<i4") if with_ids else None)
                        for c, v in zip(out, row, strict=True):
                            out[c].append(v)
                yield {"doc_id": given.take(pa.array(out.pop("at"), pa.int64())), **out}

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    out = map_arrow(slim, run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>")
    return out if with_ids else out.drop("ids")


def pack(pieces: DataFrame, rows: int, size: int = SEQUENCE, open_bins: int = 1024, group_rows: int = 50_000, seed: int = 11) -> DataFrame:
    """``pieces`` (of ``tokenised_pieces``; other columns stay) with sequence_id and offset.

    ``rows``: about how many there are; it sets the number of groups only.
    """
    groups = max(1, -(-rows // group_rows))
    order = F.xxhash64(F.lit(seed), "doc_id", "piece", "ids_crc32")
    dealt = pieces.withColumn("_h", order).withColumn("_g", F.pmod("_h", F.lit(groups)))
    dealt = dealt.repartition(max(groups, 1), "_g").sortWithinPartitions("_g", "_h")
    n = len(pieces.columns)
    schema = dealt.drop("_h", "_g").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        group, fed, packed = None, deque(), None
        for batch in batches:
            seq, off = [], []
            for g, length in zip(batch.column("_g").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if g != group:
                    group, fed = g, deque()
                    packed = best_fit(iter(fed.popleft, None), size, open_bins)
                fed.append(length)
                b, o = next(packed)
                seq.append((g << 40) + b)
                off.append(o)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], schema=target)

    small_batches(dealt.sparkSession)
    return dealt.mapInArrow(handing_back(run), schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, with_ids: bool = False, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): a row per piece."""
    return pack(tokenised_pieces(docs, tokenizer, id_col, text_col, size, with_ids), docs.count(), size, **options)
