"""Quality rules: hashed n-gram log-likelihood ratio, with repetition rules before it.

A trusted-target multinomial (labelled good documents) and a raw-corpus multinomial
(all documents) are counted over hashed word 1- and 2-grams.  A document's score is
the sum of the buckets' log ratios divided by its number of n-grams; a fixed threshold
decides each document alone, so the decision does not depend on other rows of a batch.

Raw counts cover every document.  The target is a bounded sample of labelled rows
(``max_target``, smallest hashes of the id), which makes the labelled ids small enough
to broadcast.  Count tables have ``2 * buckets`` numbers, whatever the corpus.

Defined cases: null and empty texts have no words, zero counts and fail the base rule;
null ids keep their row; repeated rows are counted and judged each; an empty table, no
labels or no target give ratio 0 everywhere; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, filter_texts, hash_words, map_texts, mix, shingle_hashes, slices, utf8

BUCKETS = 10_000
MAX_TARGET = 4_000
THRESHOLD = -0.065
PRIOR = 10_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _grams(words: np.ndarray, buckets: int) -> np.ndarray:
    both = np.concatenate((mix(words ^ np.uint64(0x51)), shingle_hashes(words, 2) if len(words) > 1 else words[:0]))
    return (both % np.uint64(buckets)).astype(np.int64)


def target_ids(labels: DataFrame, max_target: int = MAX_TARGET) -> DataFrame:
    """At most ``max_target`` ids with quality 1, those of the smallest hashes."""
    return (
        labels.where("quality = 1 AND doc_id IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("target_id"))
        .distinct()
        .orderBy(F.xxhash64("target_id"), "target_id")
        .limit(max_target)
    )


def fit(
    documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, max_target: int = MAX_TARGET
) -> np.ndarray:
    """Log ratio of target to raw probability for each bucket; ``PRIOR`` counts of the raw shares smooth the target."""
    flagged = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(target_ids(labels, max_target)), F.col("doc_id") == F.col("target_id"), "left"
    ).select("text", F.col("target_id").isNotNull().alias("trusted"))

    def count(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                words, at = hash_words(utf8(part.column(0).to_pylist()))
                for i, trusted in enumerate(part.column(1).to_pylist()):
                    counts = np.bincount(_grams(words[at[i] : at[i + 1]], buckets), minlength=buckets)
                    raw += counts
                    if trusted:
                        target += counts
        keep = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keep), pa.array(raw[keep]), pa.array(target[keep])], names=["bucket", "raw", "target"]
        )

    counts = (
        flagged.mapInArrow(count, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .collect()  # at most `buckets` rows
    )
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in counts:
        raw[row.bucket] = row.raw
        target[row.bucket] = row.target
    if not target.sum():
        return np.zeros(buckets)
    return log_ratio(raw, target)


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the smoothed target share over the raw share of each bucket."""
    share = np.maximum(raw, 1.0) / max(1.0, raw.sum())
    return np.log((target + PRIOR * share) / (target.sum() + PRIOR)) - np.log(share)


def text_counts(data: bytes, words: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    buf = np.frombuffer(data, np.uint8)
    chars = int(np.count_nonzero((buf & 0xC0) != 0x80)) - int(np.count_nonzero(SPACE[buf]))
    symbols = int(np.count_nonzero(_SYMBOL[buf]))
    lines = data.split(b"\n")
    duplicates = 0
    if len(lines) > 1:
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                duplicates += 1
            elif line.strip(b" \t\r\x0b\x0c"):
                seen.add(line)
    repeated = 0
    if len(words) >= 5:
        windows = shingle_hashes(words, 5)
        order = np.sort(windows)
        again = order[1:][order[1:] == order[:-1]]
        if len(again):
            hit = np.flatnonzero(np.isin(windows, again))
            cover = np.zeros(len(words) + 1, np.int32)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + 5, -1)
            repeated = int(np.count_nonzero(np.cumsum(cover)[:-1]))
    return chars, symbols, duplicates, repeated


def verdicts(texts: list, ratio: np.ndarray, threshold: float) -> list[tuple]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score of each text."""
    data = utf8(texts)
    words, at = hash_words(data)
    out = []
    for i, text in enumerate(data):
        own = words[at[i] : at[i + 1]]
        n = len(own)
        counts = text_counts(text, own)
        failed = n < 10 or 100 * counts[3] > 20 * n
        grams = _grams(own, len(ratio))
        score = float(ratio[grams].sum() / len(grams)) if len(grams) else 0.0
        out.append((n, *counts, failed, not failed and score >= threshold, score))
    return out


def judge(documents: DataFrame, ratio: np.ndarray, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document with its counts, score and verdict."""
    shared = documents.sparkSession.sparkContext.broadcast(ratio)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean, score double"
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = zip(*verdicts(batch.column(1).to_pylist(), shared.value, threshold), strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", *names]
        )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, run, schema)


def keep(documents: DataFrame, ratio: np.ndarray, *, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(ratio)
    return filter_texts(documents, "text", lambda texts: [v[6] for v in verdicts(texts, shared.value, threshold)])
