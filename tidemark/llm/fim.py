"""Fill-in-middle transformation with cuts located in a wavelet matrix.

Every byte of a text's UTF-8 form falls into a class: inside a character, a character inside a word,
a character that starts a word, a character that starts a line.  A wavelet matrix over these classes
answers "how many of class c lie before byte i"; the ranks of several classes add up to the number of
boundaries of a unit (character, word or line), and bisection on that sum finds the byte where a cut
after k units lies.  The matrix takes half a byte for each byte of text.

Which units are cut, and how a document is written, follow from hashes of the seed and the document's
id: the result doesn't depend on partitions, retries or the order of rows.  No rows are shuffled.

Defined cases: a null text counts as empty and is written as it is (``plain``), as are texts that contain a
sentinel; a null id hashes as the empty string; repeated rows are transformed each; very long texts are
handled whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, map_texts

INSIDE, CHARACTER, WORD, LINE = range(4)
BITS = 2
#: The classes whose members start a unit.
UNITS = {"char": (CHARACTER, WORD, LINE), "word": (WORD, LINE), "line": (LINE,)}


class Sentinels(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class _Bits:
    """A bit vector with rank: ones before each word of 64 bits, and the words."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate((packed, np.zeros(8 + -len(packed) % 8, np.uint8))).view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, i: int) -> int:
        at = i >> 6
        return int(self.before[at]) + (int(self.words[at]) & ((1 << (i & 63)) - 1)).bit_count()


class WaveletMatrix:
    """Ranks of each symbol of a sequence of numbers below ``2**bits``."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.size = len(sequence)
        self.levels: list[tuple[int, _Bits, int]] = []
        for shift in reversed(range(bits)):
            ones = (sequence >> shift & 1).astype(bool)
            self.levels.append((shift, _Bits(ones), self.size - int(np.count_nonzero(ones))))
            if shift:
                sequence = np.concatenate((sequence[~ones], sequence[ones]))

    def rank(self, symbol: int, i: int) -> int:
        """How often ``symbol`` stands before place ``i``."""
        low, high = 0, i
        for shift, bits, zeros in self.levels:
            a, b = bits.rank(low), bits.rank(high)
            low, high = (zeros + a, zeros + b) if symbol >> shift & 1 else (low - a, high - b)
        return high - low


def classes(buf: np.ndarray) -> np.ndarray:
    """The class of each byte of a UTF-8 text."""
    out = ((buf & 0xC0) != 0x80).astype(np.uint8)  # INSIDE or CHARACTER
    white = SPACE[buf]
    out[1:][white[:-1] & ~white[1:]] = WORD
    out[1:][buf[:-1] == 10] = LINE
    out[:1] = LINE
    return out


class Cutter:
    """Counts the units of one text and finds where they end."""

    def __init__(self, text: bytes, unit: str = "char"):
        self.starts = UNITS[unit]
        self.matrix = WaveletMatrix(classes(np.frombuffer(text, np.uint8)), BITS)
        self.units = self.before(self.matrix.size)

    def before(self, i: int) -> int:
        """How many units start before byte ``i``."""
        return sum(self.matrix.rank(c, i) for c in self.starts)

    def cut(self, k: int) -> int:
        """The byte where the first ``k`` units end."""
        if k >= self.units:
            return self.matrix.size
        low, high = k, self.matrix.size - (self.units - k)  # a unit has a byte at least
        while low < high:
            mid = (low + high + 1) // 2
            if self.before(mid) <= k:
                low = mid
            else:
                high = mid - 1
        return low


def _hash_part(hashed: Column, i: int) -> Column:
    return F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long")


def transform(
    documents: DataFrame, *, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, unit: str = "char",
    sentinels: Sentinels = Sentinels(), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units, output.

    ``plain_percent`` of the documents stay as they are, ``spm_percent`` of the others are written suffix first
    (``spm``), the rest prefix first (``psm``).
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    taken = F.lit(False)
    for mark in sentinels:
        taken = taken | F.col("text").contains(mark)
    form = (
        F.when((F.col("text") == "") | taken | (F.col("h3") % 100 >= 100 - plain_percent), "plain")
        .when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    )
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("hashed", hashed).select("doc_id", "text", *[_hash_part(F.col("hashed"), i).alias(f"h{i + 1}") for i in range(4)])
    rows = rows.select("doc_id", "text", form.alias("form"), "h1", "h2")
    p, s, m = (x.encode() for x in sentinels)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        units, first, second, outputs = [], [], [], []
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for text, form, h1, h2 in zip(texts, *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            cutter = Cutter(text, unit)
            n = cutter.units
            units.append(n)
            if form == "plain":
                first.append(None)
                second.append(None)
                outputs.append(text)
                continue
            a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
            x, y = cutter.cut(a), cutter.cut(b)
            first.append(a)
            second.append(b - a)
            begin, middle, end = text[:x], text[x:y], text[y:]
            outputs.append(b"".join((p, begin, s, end, m, middle) if form == "psm" else (s, end, p, begin, m, middle)))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(units, pa.int64()), batch.column(2), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                pa.array(outputs, pa.binary()).cast(pa.string()),
            ],
            names=["doc_id", "n", "form", "prefix_units", "middle_units", "output"],
        )

    return map_texts(rows, run, "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: str | Column = "output", form: str | Column = "form", sentinels: Sentinels = Sentinels()) -> Column:
    """The text that was transformed, from what was written and its form alone."""
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = sentinels

    def between(left: str, right: str | None) -> Column:
        rest = F.substring_index(out, left, -1)
        return F.substring_index(rest, right, 1) if right else rest

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "plain", out).when(form == "psm", psm).otherwise(spm)


def digests(transformed: DataFrame) -> DataFrame:
    """The transformed rows with SHA-256 of what was written and of the text rebuilt from it."""
    return transformed.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"),
    )
