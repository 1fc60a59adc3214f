"""License scans by diagonal voting.

Every text is a sequence of words, every template too.  The rolling hashes of
all the texts' word grams are joined to the templates' grams; a match of place
``p`` in a text and ``q`` in a template is a vote for the diagonal ``p - q``,
where the template would begin.  Votes are counted by text, template and
diagonal; neighbouring diagonals, apart by inserted or missing words, are one
span; spans with enough votes are compared word by word with the template.

Phrases are short and must stand as they are: all their grams on one diagonal.
Notices may have words changed: ``ACCEPTED`` of the template's words must be
found in order.  The grams' join sends the templates to the texts, which are
not shuffled; only votes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_bytes
from .common import binary_text, column_or_null, cut_lineage, map_rows

PHRASE_GRAM = 2
NOTICE_GRAM = 4
# Diagonals of a notice so far apart, or less, are of one span.
DRIFT = 3
# Of a notice's grams so many must vote before words are compared, and of its words so many must be found.
VOTES = 0.2
ACCEPTED = 0.8
SEED = 42
REMEMBERED_WORDS = 1 << 18
# Bytes of a candidate row beside others in a hash table, for the choice of the join.
CANDIDATE_BYTES = 200

# The given phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Names of further licenses, as they are written.
OWN_PHRASES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
}
# Published notices.
NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
}

# A-Z lowered; digits, letters and all bytes of longer UTF-8 sequences stand in words, other bytes part them.
_PARTS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    """The lower-cased maximal matches of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(_PARTS).split() if text else []


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[bytes, ...]
    kind: str  # "base", "phrase" or "notice"

    @property
    def gram(self) -> int:
        return NOTICE_GRAM if self.kind == "notice" else PHRASE_GRAM

    @property
    def grams(self) -> int:
        return len(self.words) - self.gram + 1


def default_templates() -> list[Template]:
    listed = [(label, text, "base") for text, label in BASE_PHRASES.items()]
    listed += [(label, text, "phrase") for text, label in OWN_PHRASES.items()]
    listed += [(label, text, "notice") for label, text in NOTICES.items()]
    return [Template(k, label, tuple(words(text.encode())), kind) for k, (label, text, kind) in enumerate(listed)]


class _WordHashes(dict):
    """XXH64 of words; frequent ones are found again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words, from the words' hashes; modulo 2^64."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    found = np.full(count, size, dtype=np.uint64)
    for k in range(size):
        found = found * _FACTOR + hashes[k : k + count]
    return found


def gram_hashes(tokens: list[bytes], known: _WordHashes) -> np.ndarray:
    """The short grams' hashes in order, then the long ones', as signed numbers."""
    hashes = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    return np.concatenate([rolling(hashes, PHRASE_GRAM), rolling(hashes, NOTICE_GRAM)]).view(np.int64)


def template_grams(templates: list[Template]) -> list[tuple[int, int, int]]:
    """``(gram, template, place)``."""
    known, found = _WordHashes(), []
    for template in templates:
        hashes = np.fromiter(map(known.__getitem__, template.words), dtype=np.uint64, count=len(template.words))
        found += [(gram, template.number, place) for place, gram in enumerate(rolling(hashes, template.gram).view(np.int64).tolist())]
    return found


def row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a row's text; rows of equal texts have equal spans."""
    text = F.col("text").cast("string")
    return F.xxhash64(text, F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2")


def _grams(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, n_words, grams`` for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            sizes, grams = [], []
            for text in batch.column(3):
                tokens = words(text.as_py())
                sizes.append(len(tokens))
                grams.append(gram_hashes(tokens, known))
            ends = np.cumsum([0, *map(len, grams)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams)))
            yield pa.record_batch([*batch.columns[:3], pa.array(sizes, pa.int64()), listed], names=["doc_id", "k1", "k2", "n_words", "grams"])

    rows = docs.select(column_or_null(docs, "doc_id", "bigint"), *row_keys(docs), binary_text())
    return map_rows(rows, work, "doc_id bigint, k1 bigint, k2 bigint, n_words bigint, grams array<bigint>")


def votes(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """``row, doc_id, k1, k2, n_words, template, diagonal, votes``; each row of ``docs`` has one row at least.

    The first gram of a text stays without a match, so that no text is lost;
    other grams without a match end in the task that made them.
    """
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(template_grams(templates), "gram bigint, template int, place int"))
    rows = _grams(docs).withColumn("row", F.monotonically_increasing_id())
    met = rows.select("row", "doc_id", "k1", "k2", "n_words", F.posexplode_outer("grams").alias("at", "gram")).join(known, "gram", "left")
    met = met.where(F.col("template").isNotNull() | F.col("at").isNull() | (F.col("at") == 0))
    short = F.greatest(F.col("n_words") - (PHRASE_GRAM - 1), F.lit(0))
    start = F.when(F.col("at") < short, F.col("at")).otherwise(F.col("at") - short)
    met = met.withColumn("diagonal", F.when(F.col("template").isNotNull(), start - F.col("place")))
    return met.groupBy("row", "doc_id", "k1", "k2", "n_words", "template", "diagonal").agg(F.count(F.lit(1)).alias("votes"))


def candidates(voted: DataFrame, templates: list[Template]) -> DataFrame:
    """``k1, k2, template, first, last``: texts' spans with enough votes, by their outermost diagonals."""
    facts = voted.sparkSession.createDataFrame(
        [(t.number, DRIFT if t.kind == "notice" else 0, VOTES * t.grams if t.kind == "notice" else float(t.grams)) for t in templates],
        "template int, drift int, least double",
    )
    told = voted.where("template is not null").join(F.broadcast(facts), "template")
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    parted = told.withColumn("_new", (F.col("diagonal") - F.lag("diagonal").over(along) > F.col("drift")).cast("int"))
    spans = parted.withColumn("_span", F.coalesce(F.sum("_new").over(along), F.lit(0)))
    merged = spans.groupBy("row", "k1", "k2", "template", "least", "_span").agg(
        F.sum("votes").alias("_votes"), F.min("diagonal").alias("first"), F.max("diagonal").alias("last")
    )
    return merged.where(F.col("_votes") >= F.col("least") - 1e-9).select("k1", "k2", "template", "first", "last").distinct()


def words_in_order(template: tuple[bytes, ...], span: list[bytes]) -> int:
    """Length of the longest common subsequence; a bit per word of the template."""
    held: dict[bytes, int] = {}
    for k, word in enumerate(template):
        held[word] = held.get(word, 0) | 1 << k
    whole = open_ = (1 << len(template)) - 1
    for word in span:
        if hit := open_ & held.get(word, 0):
            open_ = ((open_ + hit) | (open_ - hit)) & whole
    return len(template) - open_.bit_count()


def verify(tokens: list[bytes], template: Template, first: int, last: int) -> float:
    """The share of the template's words found in order where it would stand; phrases are found or not."""
    begin = max(first, 0)
    if template.kind != "notice":
        return float(first >= 0 and tuple(tokens[begin : begin + len(template.words)]) == template.words)
    return words_in_order(template.words, tokens[begin : last + len(template.words)]) / len(template.words)


def _verified(docs: DataFrame, asked: DataFrame, templates: list[Template]) -> tuple[DataFrame, bool]:
    """``k1, k2, template, first, share`` for each candidate, compared with the text's words; whether they are few."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], [], []]
            for k1, k2, text, spans in zip(*[column.to_pylist() for column in batch.columns]):
                tokens = words(text)
                for span in spans:
                    share = verify(tokens, templates[span["template"]], span["first"], span["last"])
                    for column, value in zip(found, (k1, k2, span["template"], span["first"], share)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64())
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(found, kinds)], names=["k1", "k2", "template", "first", "share"])

    spans = cut_lineage(asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("template", "first", "last")).alias("spans")))
    texts, listed = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    # Few candidates go to the texts; beyond the bound texts and candidates meet by key.
    small = (texts + listed) * CANDIDATE_BYTES <= broadcast_bytes(docs.sparkSession)
    rows = docs.select(*row_keys(docs), binary_text()).join(F.broadcast(spans) if small else spans, ["k1", "k2"])
    return map_rows(rows.select("k1", "k2", "text", "spans"), work, "k1 bigint, k2 bigint, template int, first bigint, share double").distinct(), small


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``, a row for each row.

    ``n_base`` counts the places of the given phrases, overlapping ones too.
    ``score`` is 1 where a phrase stands, else the largest share of a notice's
    words that a span has, 0 without one; a notice gives its label from
    ``ACCEPTED`` on.  Null and empty texts have no words and no labels.  Null
    ids and repeated rows stay as they are; other columns are not read.  No rows
    give no rows.
    """
    templates = default_templates() if templates is None else templates
    voted = cut_lineage(votes(docs, templates))
    found, small = _verified(docs, candidates(voted, templates), templates)
    names = docs.sparkSession.createDataFrame([(t.number, t.label, t.kind) for t in templates], "template int, label string, kind string")
    named = found.join(F.broadcast(names), "template")
    base = (F.col("kind") == "base") & (F.col("share") == 1)
    accepted = F.col("share") >= F.when(F.col("kind") == "notice", F.lit(ACCEPTED)).otherwise(F.lit(1.0))
    by_text = named.groupBy("k1", "k2").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(accepted, F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    rows = voted.select("row", "doc_id", "k1", "k2", "n_words").distinct().join(F.broadcast(by_text) if small else by_text, ["k1", "k2"], "left")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
