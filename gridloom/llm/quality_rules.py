"""Quality rules as a short-circuit cascade.

On a bounded sample the order is built rule by rule: of the rules left, each one's cost (seconds a text, beyond what the
rules before it have computed) and selectivity (share of the texts still there that it rejects) are measured, and the one
with the most rejection per cost comes next. A text leaves the cascade at the first rule that rejects it. The order changes
the time only: a text is kept if no rule rejects it, whatever comes first. A null text has no words; ids and other columns
are carried as they are, equal rows are judged alike, texts of any length whole; an empty table gives none.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import handing_back, map_arrow, small_batches

SYMBOLS = b"#*$%&|<>"


class Page:
    """A text whose measures are computed when a rule first asks for them."""

    def __init__(self, body: bytes):
        self.body = body

    def copy(self) -> Page:
        """A page with the measures that are there by now."""
        other = Page(self.body)
        other.__dict__.update(self.__dict__)
        return other

    @cached_property
    def words(self) -> list[bytes]:
        return self.body.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        joined = b"".join(self.words)
        return len(joined) - sum(map(joined.count, CONTINUED)) if not joined.isascii() else len(joined)

    @cached_property
    def n_symbols(self) -> int:
        return len(self.body) - len(self.body.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.body.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        grams = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(grams)) == len(grams):
            return 0
        seen, hit = Counter(grams), bytearray(len(w))
        for i, g in enumerate(grams):
            if seen[g] > 1:
                hit[i : i + 3] = b"\1\1\1"
        return sum(hit)

    @cached_property
    def n_upper(self) -> int:
        return len(self.body) - len(self.body.translate(None, UPPER))

    @cached_property
    def n_letters(self) -> int:
        return len(self.body) - len(self.body.translate(None, UPPER + UPPER.lower()))


CONTINUED = [bytes([b]) for b in range(0x80, 0xC0)]
UPPER = bytes(range(65, 91))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Page], bool]


def default_rules(min_words: int = 50, max_repeat: float = 0.5, max_symbols: float = 0.1, max_dup_lines: float = 0.4, max_upper: float = 0.5, max_bangs: float = 0.2) -> list[Rule]:
    """The first two are the base rules."""
    return [
        Rule("few_words", lambda p: p.n_words < min_words),
        Rule("repeats", lambda p: p.n_repeat_words > max_repeat * p.n_words),
        Rule("symbols", lambda p: p.n_symbols > max_symbols * p.n_words),
        Rule("word_length", lambda p: not 2 * p.n_words <= p.word_chars <= 12 * p.n_words),
        Rule("dup_lines", lambda p: p.n_dup_lines > max_dup_lines * len(p.lines)),
        Rule("shouting", lambda p: p.n_letters > 20 and p.n_upper > max_upper * p.n_letters),
        Rule("exclamations", lambda p: p.body.count(b"!!") > max_bangs * p.n_words),
    ]


BASE_RULES = 2


def measured(rule: Rule, pages: list[Page]) -> tuple[float, float]:
    """(seconds a text, share rejected) of a rule that comes next for these pages, which stay as they are."""
    copies = [p.copy() for p in pages]
    began = time.perf_counter()
    gone = sum(rule.rejects(p) for p in copies)
    return (time.perf_counter() - began) / max(1, len(pages)), gone / max(1, len(pages))


def ordered(rules: list[Rule], bodies: list[bytes], measure: Callable[[Rule, list[Page]], tuple[float, float]] = measured) -> list[Rule]:
    """The rules by rejection per cost, each measured after those before it on the texts that these leave."""
    pages, left, out = [Page(b) for b in bodies], list(rules), []
    while left:
        gain = {}
        for rule in left:
            cost, share = measure(rule, pages)
            gain[rule.name] = (share + 1e-4) / (cost + 1e-9)
        best = max(left, key=lambda r: gain[r.name])
        left.remove(best)
        out.append(best)
        pages = [p for p in pages if not best.rejects(p)]
    return out


def plan(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = 300, seed: int = 7, sample_bytes: int = 64 << 10) -> list[Rule]:
    """Rules by rejection per cost, both estimated on ``sample_rows`` rows at most, each of ``sample_bytes`` or less, so that the
    driver gets a bounded sample (only the order depends on it)."""
    rules = rules or default_rules()
    text = docs.select(F.col(text_col).alias("t")).where(F.coalesce(F.octet_length("t"), F.lit(0)) <= sample_bytes)
    rows = text.sample(0.05, seed=seed).limit(sample_rows).collect()
    return ordered(rules, [(r["t"] or "").encode() for r in rows])


def verdict(page: Page, cascade: list[Rule]) -> str | None:
    """The name of the first rule that rejects the text."""
    for rule in cascade:
        if rule.rejects(page):
            return rule.name
    return None


def keep_by_rules(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = 300) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all columns."""
    cascade = plan(docs, text_col, rules, sample_rows)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([verdict(Page((t or "").encode()), cascade) is None for t in batch.column(at).to_pylist()], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(handing_back(run), docs.schema)


def rate_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = 300) -> DataFrame:
    """Per row: its id, the measures, ``base_failed``, ``kept`` and ``rejected_by`` (one of the rules that reject the text)."""
    rules = rules or default_rules()
    base = rules[:BASE_RULES]
    cascade = [r for r in plan(docs, text_col, rules, sample_rows) if r not in base]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        for batch in batches:
            out = {c: [] for c in (*names, "base_failed", "kept", "rejected_by")}
            for body in batch.column("body").to_pylist():
                page = Page(body or b"")
                why = next((r.name for r in base if r.rejects(page)), None)
                failed = why is not None
                why = why or verdict(page, cascade)
                for c in names:
                    out[c].append(getattr(page, c))
                out["base_failed"].append(failed)
                out["kept"].append(why is None)
                out["rejected_by"].append(why)
            yield {"doc_id": batch.column("doc_id"), **out}

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return map_arrow(slim, run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, kept boolean, rejected_by string")

