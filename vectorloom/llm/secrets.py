"""Secret scans: known shapes, and stretches of high entropy in candidate strings.

Known shapes are three patterns.  Besides, every run of 20 or more characters
that keys are written in is a candidate: a window slides over it, its counts of
characters are kept by adding one and removing one, and windows whose Shannon
entropy reaches the bound of their character class are joined into spans.
Allowed strings (placeholders, sequences, digits alone, plain words) are cut out
of a candidate before; what stands beside them is tested like any other run.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import binary_text, column_or_null, map_rows

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20

# The given patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")

# Bits of entropy that a window must reach, by the class of its characters.
ENTROPY_BITS = {"hex": 3.0, "alnum": 3.6, "symbols": 3.8, "letters": 3.8}
# Letters alone have a class where so many are of each case; names in camel case have fewer capitals.
LEAST_OF_CASE = 5

# Strings that look random and are not secrets; matched within the candidate, in lower case.
ALLOWED = (
    "example", "placeholder", "changeme", "your_", "your-", "xxxx", "dummy", "sample", "lorem",
    "0123456789", "123456789", "abcdefgh", "deadbeef", "http", "www.",
)
# Checksums are allowed with the digest that follows.
CHECKSUMS = ("sha256-(?:[0-9a-f]{64}|[a-z0-9+/]{43}=?)?", "sha512-(?:[0-9a-f]{128}|[a-z0-9+/]{86}(?:==)?)?")
ALLOWED_PARTS = re.compile("|".join([*CHECKSUMS, *map(re.escape, ALLOWED)]), re.IGNORECASE | re.ASCII)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")

_GAIN = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def base_spans(text: str, low: bytes) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the known shapes; ends are exclusive, in code points."""
    found = []
    if any(word in low for word in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # A run of 16 is what is left of the runs after shorter ones are dropped.
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def tested_parts(candidate: str) -> list[tuple[int, int]]:
    """The stretches of a candidate beside what only looks random, a window long at least."""
    if candidate.isdigit() or UUID.fullmatch(candidate):
        return []
    parts, at = [], 0
    for m in ALLOWED_PARTS.finditer(candidate):
        parts.append((at, m.start()))
        at = m.end()
    parts.append((at, len(candidate)))
    return [(a, b) for a, b in parts if b - a >= WINDOW]


def window_class(digits: int, upper: int, lower: int, beyond_hex: int, symbols: int) -> str | None:
    """The class of a window with so many characters of each sort; None for words and numbers."""
    if not digits:
        return "letters" if not symbols and min(upper, lower) >= LEAST_OF_CASE else None
    if not (upper or lower):
        return None
    if symbols:
        return "symbols"
    return "alnum" if beyond_hex or (upper and lower) else "hex"


def entropy_spans(candidate: str, width: int = WINDOW, bits: dict[str, float] = ENTROPY_BITS) -> list[tuple[int, int]]:
    """Joined stretches of windows that reach their class's bound.

    The sum of ``c log2 c`` over the counts gives the entropy; each step of the
    window changes two counts, so a candidate costs its length.
    """
    counts: dict[str, int] = {}
    sorts = [0] * 5
    total, spans = 0.0, []

    def shift(char: str, by: int) -> float:
        had = counts.get(char, 0)
        counts[char] = had + by
        if char.isdigit():
            sorts[0] += by
        elif char.isalpha():
            sorts[1 if char.isupper() else 2] += by
            if char not in "abcdefABCDEF":
                sorts[3] += by
        else:
            sorts[4] += by
        return _GAIN[had + by] - _GAIN[had]

    for end, char in enumerate(candidate, 1):
        total += shift(char, 1)
        if end > width:
            total += shift(candidate[end - width - 1], -1)
        if end < width:
            continue
        kind = window_class(*sorts)
        if kind is not None and math.log2(width) - total / width >= bits[kind] - 1e-9:
            start = end - width
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((start, end))
    return spans


def find_spans(text: str, low: bytes) -> list[tuple[int, int, int]]:
    """All spans by start, then kind: the known shapes and the entropy stretches."""
    found = base_spans(text, low)
    for m in CANDIDATE.finditer(text):
        piece = m[0]
        # Without a digit or both cases no window has a class, so plain words stop here.
        if piece.islower() and not any(c.isdigit() for c in piece):
            continue
        for at, end in tested_parts(piece):
            found += [(m.start() + at + a, 3, m.start() + at + b) for a, b in entropy_spans(piece[at:end])]
    found.sort()
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def masked(text: str, spans: list[tuple[int, int, int]], label: str = "[secret]") -> str:
    """The text with every stretch that spans cover replaced by one label."""
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at or not parts:
            parts += [text[at:start], label]
        at = max(at, end)
    return "".join(parts) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans``, a row for each row.

    A null text is the empty one: no spans, the digest of nothing.  Null ids and
    repeated rows stay as they are; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, listed = [], []
            for value in batch.column(1):
                raw = value.as_py() or b""
                spans = find_spans(raw.decode(), raw.lower())
                for kind, column in enumerate(counts):
                    column.append(sum(1 for span in spans if span[1] == kind))
                base = written([span for span in spans if span[1] != 3])
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                listed.append(written(spans))
            yield pa.record_batch(
                [batch.column(0), *[pa.array(column, pa.int64()) for column in counts], pa.array(digests), pa.array(listed)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"],
            )

    rows = docs.select(column_or_null(docs, "doc_id", "bigint"), binary_text())
    return map_rows(rows, work, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, label: str = "[secret]") -> DataFrame:
    """The documents with each secret replaced by ``label`` and ``n_chars`` counted anew.

    All columns stay; rows without a secret are unchanged.  A null text stays null.
    """
    names = docs.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = [], []
            counted = batch.column(chars).to_pylist() if chars is not None else [None] * batch.num_rows
            for value, size in zip(batch.column(at), counted):
                text = value.as_py()
                if text is not None:
                    spans = find_spans(text, text.encode().lower())
                    if spans:
                        text = masked(text, spans, label)
                        size = len(text)
                texts.append(text)
                sizes.append(size)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if chars is not None:
                columns[chars] = pa.array(sizes, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_rows(docs, work, docs.schema)
