"""License scans as an exact set-similarity join, in DataFrame operations only.

Templates and text blocks are sets of words; a template is found in a block that holds its share ``threshold`` of the template's
distinct words (containment). A block is a line, or a paragraph (lines up to one without words); a template names its ``unit``.

Blocks keep only words that some template of their unit has. The join then works as set joins do: words are ordered by
how many blocks of all documents have them, rarest first; of a template with n words, o of which are needed, one of the n - o + 1
rarest is in every block that holds it (prefix filter), and one of these is among all but the last o - 1 of the block's words; a
block needs o words (length filter); and the words from the first shared one on must suffice on both sides (positional filter).
What is left is compared as whole sets. Templates are few and lie in the plan (their words are counted, ``VOCABULARY`` at most);
everything else grows with the documents and is joined and grouped by Spark.

Beside the join, phrases are found where their words stand one after the other, whatever the lines.

Words: A-Z in lower case, maximal stretches of digits, letters a-z and characters beyond ASCII. A null text has no words. Rows are
told apart by a number of their own, so null or repeated ids and equal rows get a result each. Texts may be of any length that
Spark holds; a document of one long line is one block. An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut
from gridloom.llm.decontaminate import SEPARATORS, words

#: Distinct words of all templates at most: they are literals of the plan.
VOCABULARY = 20_000
#: A line end, and whatever else is no word up to the next: the paragraphs' border.
BORDER = "\\n[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]*\\n"

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    unit: str
    text: str

    @property
    def words(self) -> list[str]:
        low = self.text.translate({c: c + 32 for c in range(65, 91)})
        return sorted(set(filter(None, re.split(SEPARATORS, low))))


#: Share of a template's words that a block must hold, by the template's unit.
THRESHOLD = {"line": 0.9, "paragraph": 0.8}

#: Notices of a line, and paragraphs of license texts.
TEMPLATES = [
    Template("apache-2.0", "line", "Licensed under the Apache License, Version 2.0"),
    Template("cc-by-nc", "line", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa", "line", "Licensed under CC BY-SA 4.0"),
    Template("gpl-3.0", "line", "This work is licensed under the GNU General Public License, version 3"),
    Template("mit", "line", "Released under the MIT License"),
    Template(
        "mit", "paragraph",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    Template(
        "isc", "paragraph",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
        "this permission notice appear in all copies.",
    ),
    Template(
        "bsd", "paragraph",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    Template(
        "apache-2.0", "paragraph",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    Template(
        "gpl", "paragraph",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    Template(
        "mpl-2.0", "paragraph",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    Template(
        "no-warranty", "paragraph",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a "
        "particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability.",
    ),
]


def needed(t: Template) -> int:
    """How many of the template's words a block must hold."""
    return max(1, math.ceil(THRESHOLD[t.unit] * len(t.words) - 1e-9))


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _structs(rows: list[dict], kinds: str) -> Column:
    return F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in r.items())) for r in rows)).cast(f"array<struct<{kinds}>>")


def phrase_places(w: Column, phrase: str) -> Column:
    """The places (from 0) in the words ``w`` where the phrase's words follow each other; empty if there are none."""
    parts = phrase.split()
    here = F.filter(F.sequence(F.lit(0), F.size(w) - len(parts)), lambda i: _all([F.get(w, i + n) == p for n, p in enumerate(parts)]))
    there = _all([F.array_contains(w, p) for p in parts]) & (F.size(w) >= len(parts))
    return F.when(there, here).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def blocks_of(docs: DataFrame, id_col: str, text_col: str, phrases: dict[str, str], vocabulary: dict[str, list[str]], least: dict[str, int]) -> DataFrame:
    """row, doc_id, n_words, the phrases' places ``p0``..., and the blocks by unit: words that templates have, of blocks that hold
    ``least`` of them. Stored: texts are split once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    lines = F.transform(F.split(low, BORDER), lambda p: F.transform(F.split(p, "\n"), words))
    # explode of an array of one keeps its value for all that follows
    split = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.explode(F.array(lines)).alias("l"))
    flat = split.withColumn("w", F.explode(F.array(F.flatten(F.flatten("l")))))
    found = lambda b, unit: F.array_intersect(b, _words(vocabulary[unit]))
    enough = lambda b, unit: F.filter(b, lambda x: F.size(x) >= least[unit])
    by_unit = {}
    if "line" in vocabulary:
        by_unit["line"] = enough(F.transform(F.flatten("l"), lambda b: found(b, "line")), "line")
    if "paragraph" in vocabulary:
        by_unit["paragraph"] = enough(F.transform("l", lambda p: found(F.flatten(p), "paragraph")), "paragraph")
    places = [phrase_places(F.col("w"), p).alias(f"p{i}") for i, p in enumerate(phrases)]
    return cut(flat.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), *places, *(c.alias(u) for u, c in by_unit.items())), "blocks")[0]


def matches(blocks: DataFrame, templates: list[Template]) -> DataFrame:
    """(row, label, held): templates that a block of the row holds, with the share of their words."""
    unit = templates[0].unit
    spark = blocks.sparkSession
    each = blocks.select("row", F.posexplode(unit).alias("block", "b"))
    vocabulary = sorted({w for t in templates for w in t.words})
    seen = {r.w: r.n for r in each.select(F.explode("b").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # the templates' words at most
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    least = min(map(needed, templates))
    listed, wanted = [], []
    for k, t in enumerate(templates):
        ws = sorted(t.words, key=rank.get)
        wanted.append({"k": k, "label": t.label, "n": len(ws), "need": needed(t), "words": ws})
        listed += [{"term": w, "k": k, "i": i} for i, w in enumerate(ws[: len(ws) - needed(t) + 1])]
    terms = spark.range(1).select(F.inline(_structs(listed, "term: string, k: int, i: int")))
    sets = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(w[c]).alias(c) for c in ("k", "label", "n", "need")), _words(w["words"]).alias("words")) for w in wanted))))
    known = F.broadcast(terms.join(sets, "k"))  # a row for each rare word of a template
    ranked = each.select("row", "block", F.array_intersect(_words(order), "b").alias("b"))
    prefix = ranked.select("row", "block", "b", F.posexplode(F.slice("b", 1, F.size("b") - least + 1)).alias("j", "term"))
    met = prefix.join(known, "term").where((F.size("b") >= F.col("need")) & (1 + F.least(F.col("n") - F.col("i"), F.size("b") - F.col("j")) - 1 >= F.col("need")))
    shared = met.withColumn("shared", F.size(F.array_intersect("words", "b"))).where("shared >= need")
    return shared.select("row", "label", (F.col("shared") / F.col("n")).alias("held"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word (of the phrases' places), base_labels, labels (arrays,
    sorted) and score: the greatest share of a template that is found, 1 with a phrase, else 0."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    templates = [t for t in templates if t.words]
    units = {u: [t for t in templates if t.unit == u] for u in sorted({t.unit for t in templates})}
    vocabulary = {u: sorted({w for t in ts for w in t.words}) for u, ts in units.items()}
    if sum(map(len, vocabulary.values())) > VOCABULARY:
        raise ValueError(f"templates may have {VOCABULARY} distinct words")
    blocks = blocks_of(docs, id_col, text_col, phrases, vocabulary, {u: min(map(needed, ts)) for u, ts in units.items()})
    found = blocks.select("row", F.lit("").alias("label"), F.lit(0.0).alias("held")).limit(0)
    for ts in units.values():
        found = found.unionByName(matches(blocks, ts))
    own = found.groupBy("row").agg(F.array_sort(F.collect_set("label")).alias("own"), F.max("held").alias("held"))
    places = [F.col(f"p{i}") for i in range(len(phrases))]
    every = F.concat(*places) if places else F.array().cast("array<int>")
    base = F.filter(F.array(*(F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(places, phrases.values(), strict=True))).cast("array<string>"), lambda x: x.isNotNull())
    base = F.array_sort(F.array_distinct(base))
    rows = blocks.select("row", "doc_id", "n_words", every.alias("every"), base.alias("base_labels")).join(own, "row", "left")
    score = F.when(F.size("base_labels") > 0, 1.0).otherwise(F.coalesce("held", F.lit(0.0)))
    none = F.array().cast("array<string>")
    at = lambda f: f("every").cast("long")
    return rows.select(
        "doc_id", "n_words", F.size("every").cast("long").alias("n_base"), at(F.array_min).alias("first_word"), at(F.array_max).alias("last_word"), "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("own", none))).alias("labels"), score.alias("score"),
    )
