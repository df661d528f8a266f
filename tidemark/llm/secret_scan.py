"""Secret scan with multipart credential linking.

Strong spans (``assign``, ``access``, ``hex``) are always reported.  Weak parts - 40-letter keys,
user or client identifiers, service endpoints - mean little alone: an interval join within
a document reports one only if a complementary part (identifier and secret, endpoint and
either) lies within ``scope`` characters.  The join looks up, for the interval around each
weak part, the parts that start before its end and the furthest end among them, so it costs
a sort, not pairs.

Positions are code points, ends exclusive.  Defined cases: null counts as the empty text and has no spans;
null ids and repeated rows keep their rows; overlapping spans of different kinds are all
reported; very long texts are scanned whole; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts

SCOPE = 400
KINDS = ("assign", "access", "hex", "key", "ident", "endpoint")
STRONG = KINDS[:3]
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "ident": "identifier", "endpoint": "endpoint"}

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEY = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
_IDENT = re.compile(
    r"""(?:client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", re.IGNORECASE | re.ASCII
)
_ENDPOINT = re.compile(r"""(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]{4,}""")


def strong_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def weak_parts(text: str) -> list[tuple[int, int, str]]:
    found = [
        (m.start(), m.end(), "key")
        for m in _KEY.finditer(text)
        if re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[g-z]", m[0])
    ]
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "ident") for m in _IDENT.finditer(text)]
    if "://" in text:
        found += [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    return found


def linked_parts(parts: list[tuple[int, int, str]], scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """The weak parts that have a part of another role within ``scope`` characters, not overlapping them."""
    by_role: dict[str, tuple[list[int], list[int]]] = {}
    for role in ("secret", "identifier", "endpoint"):
        own = sorted(p for p in parts if ROLE[p[2]] == role)
        by_role[role] = ([p[0] for p in own], list(accumulate((p[1] for p in own), max)))
    out = []
    for start, end, kind in parts:
        if kind in STRONG:
            continue
        for role, (starts, furthest) in by_role.items():
            if role == ROLE[kind]:
                continue
            before = bisect_right(starts, start - 1)  # begins before: reaches into the scope on the left?
            after = bisect_right(starts, end - 1)  # begins after: within the scope on the right?
            if before and furthest[before - 1] >= start - scope or after < len(starts) and starts[after] <= end + scope:
                out.append((start, end, kind))
                break
    return out


def spans_of(text: str | None, scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """All reported spans by start, then kind as listed."""
    text = text or ""
    strong, weak = strong_spans(text), weak_parts(text)
    return sorted(strong + (linked_parts(strong + weak, scope) if weak else []), key=lambda s: (s[0], KINDS.index(s[2])))


def redact_text(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """Each run of overlapping spans becomes ``[SECRET]``."""
    if not spans:
        return text
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id and its spans (kind, start, end) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[{"kind": k, "start": a, "end": b} for a, b, k in spans_of(t, scope)] for t in batch.column(1).to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def span_digests(spans: DataFrame) -> DataFrame:
    """Counts per strong kind, SHA-256 of the strong spans and all spans as text."""
    strong = F.filter("spans", lambda s: s["kind"].isin(*STRONG))

    def text(col):
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in STRONG],
        F.sha2(text(strong), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def redact(documents: DataFrame, *, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """The same columns and rows, secrets in ``text_col`` replaced."""
    names = documents.columns
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [redact_text(t, spans_of(t, scope)) for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=names)

    return map_texts(documents, run, documents.schema)
