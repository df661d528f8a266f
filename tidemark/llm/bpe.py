"""BPE encoding and decoding by speculation and verification.

For each distinct new word of a batch, greedy longest match proposes tokens.  All adjacent pairs
of all proposals are then tested together with numpy: a pair is compatible if merging
both tokens' letters would never merge across their border.  A proposal whose pairs
are all compatible is the BPE result; only words with an incompatible pair are merged exactly.

The test walks back through the merges of the left token's last piece and the right token's
first piece; a merged token's id is its rank, so "m would happen first" is a comparison of ids.
Tokens that merging can never produce are not proposed.

Texts of well-known characters are split by the patterns below; for others the tokenizers library normalises and splits, so that
no result depends on the Unicode version of Python.

The vocabulary file is a parameter; its text (of fixed size) is broadcast.  A worker
keeps the ids of at most ``CACHE_WORDS`` words.

Defined cases: a null text counts as empty and gives no ids; null ids keep their row; repeated
rows are encoded each; very long texts are cut at blanks, which no token crosses; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WELL_KNOWN, map_texts

CACHE_WORDS = 400_000
CHUNK_CHARS = 1 << 20
MANY_LETTERS = 64
_NONE = np.int64(1 << 40)
_SPACES = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_WHITE = re.compile(r"[\t\n\x0b\x0c\r ]")
_loaded: dict[str, WordBpe] = {}


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(extra)) for b in range(256)]


def _word_pattern(letter: str, digit: str) -> regex.Pattern:
    return regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{digit}|[^{_SPACES}{letter}{digit}]+", regex.V1)


# The parts of a tokenizer file that the code below carries out; files with others are refused.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
PLAIN_SPECIAL = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}


def check_supported(spec: dict) -> None:
    """Raises for a tokenizer file that asks for anything else than what this module does."""
    wanted = {"normalizer": NORMALIZER, "pre_tokenizer": PRE_TOKENIZER, "decoder": None}
    wrong = [k for k, v in wanted.items() if spec.get(k) != v]
    wrong += [f"model.{k}" for k, v in PLAIN_MODEL.items() if spec["model"].get(k, v) != v]
    wrong += [f"added token {t['content']!r}" for t in spec["added_tokens"] if any(t.get(k) != v for k, v in PLAIN_SPECIAL.items())]
    if wrong:
        raise ValueError(f"tokenizer file asks for what isn't carried out here: {', '.join(wrong)}")


class WordBpe:
    """A word-level byte BPE with an end-of-word suffix, from a tokenizer file's JSON text."""

    def __init__(self, source: str):
        spec = json.loads(source)
        check_supported(spec)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for text, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = text
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.merged: dict[tuple[int, int], int] = {}
        last = -1
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = self.vocab[a + b]
            left, right = self.vocab[a], self.vocab[b]
            if not last < whole or max(left, right) >= whole:
                raise ValueError("token ids must follow the order of the merges")
            last = whole
            self.left[whole], self.right[whole] = left, right
            self.merged[left, right] = whole
        keys = np.array([a * size + b for a, b in self.merged], np.int64)
        order = np.argsort(keys)
        self._keys, self._whole = keys[order], np.array(list(self.merged.values()), np.int64)[order]
        self._size = size
        self.letters = _byte_letters()
        self._bytes = {c: b for b, c in enumerate(self.letters)}
        self._source, self._library = source, None
        made = np.flatnonzero(self.left >= 0)
        good = np.ones(size, bool)
        good[made] = self._compatible(self.left[made], self.right[made], known=True)
        for i in made.tolist():  # children have smaller ids
            good[i] = good[i] and good[self.left[i]] and good[self.right[i]]
        self._proposed = {t: i for t, i in self.vocab.items() if good[i] and t not in self.special}
        self._longest = max(len(t) for t in self._proposed)
        self._pattern = _word_pattern(r"\p{L}", r"\p{N}")
        self._specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._cache: dict[str, bytes] = {}

    def _pair(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self._size + y
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._whole[at], _NONE)

    def _compatible(self, x: np.ndarray, y: np.ndarray, known: bool = False) -> np.ndarray:
        """Which pairs (x, y) stay apart; ``known``: the pairs themselves are merges, look only inside them."""
        x, y = x.copy(), y.copy()
        ok = np.ones(len(x), bool)
        until_x, until_y = np.full(len(x), _NONE), np.full(len(x), _NONE)
        if known:  # the merge that joins them bounds the time in which others may come first
            until_x[:] = until_y[:] = self._pair(x, y)
            until_y -= 1
        live = np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            m = self._pair(a, b)
            clash = (m < until_x[live]) & (m <= until_y[live])
            ok[live[clash]] = False
            live = live[~clash]
            a, b = x[live], y[live]
            back_x = (a > b) & (self.left[a] >= 0)
            back_y = ~back_x & (self.left[b] >= 0)
            i, j = live[back_x], live[back_y]
            until_x[i], x[i] = x[i], self.right[x[i]]
            until_y[j], y[j] = y[j], self.left[y[j]]
            live = live[back_x | back_y]
        return ok

    def _propose(self, letters: str) -> list[int]:
        found, at, n = [], 0, len(letters)
        while at < n:
            for stop in range(min(n, at + self._longest), at, -1):
                i = self._proposed.get(letters[at:stop] + self.suffix if stop == n else letters[at:stop])
                if i is not None:
                    found.append(i)
                    at = stop
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return found

    def merge_exactly(self, letters: str) -> list[int]:
        """Lowest rank first, leftmost first; long words over a heap and a linked list."""
        ids = [self.vocab[c] for c in letters[:-1]] + [self.vocab[letters[-1] + self.suffix]]
        n = len(ids)
        if n <= MANY_LETTERS:
            get, never = self.merged.get, 1 << 40
            ranks = [get(p, never) for p in zip(ids, ids[1:], strict=False)]
            while ranks and (whole := min(ranks)) < never:
                i = ranks.index(whole)
                ids[i : i + 2] = [whole]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((ids[i - 1], whole), never)
                if i < len(ranks):
                    ranks[i] = get((whole, ids[i + 1]), never)
            return ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(self.merged[p], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.merged]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            whole, i, pair = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], gone[j] = whole, True
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (ids[a], ids[b])) in self.merged:
                    heapq.heappush(heap, (self.merged[p], a, p))
        return [x for x, dead in zip(ids, gone, strict=True) if not dead]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct normalised words."""
        letters = ["".join([self.letters[b] for b in w.encode("utf-8", "surrogatepass")]) for w in words]
        proposals = [self._propose(x) for x in letters]
        flat = np.array([i for p in proposals for i in p], np.int64)
        owner = np.repeat(np.arange(len(proposals)), [len(p) for p in proposals])
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        bad = inside[~self._compatible(flat[inside], flat[inside + 1])]
        for i in np.unique(owner[bad]).tolist():
            proposals[i] = self.merge_exactly(letters[i])
        return proposals

    def _pieces(self, text: str) -> Iterator[list[str] | int]:
        """Word lists and special ids, in order."""
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > CHUNK_CHARS:
                cut = _WHITE.search(text, at + CHUNK_CHARS)
                stop = cut.end() if cut else stop
            part = text[at:stop]
            at = stop
            split = self._specials.split(part) if self._specials and any(s in part for s in self.special) else [part]
            for piece in split:
                if piece in self.special:
                    yield self.special[piece]
                elif piece.isascii():
                    yield self._pattern.findall(piece.lower())
                elif piece and WELL_KNOWN.fullmatch(piece):
                    yield self._pattern.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())
                elif piece:
                    yield self._split_by_library(piece)

    def _split_by_library(self, piece: str) -> list[str]:
        """Words of a text with characters on which versions of Unicode may differ: the library's own tables decide."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._source)
        found = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(piece))
        return [bytes([self._bytes[c] for c in word]).decode() for word, _ in found]

    def encode_batch(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of each text; new words are looked at together for about a million characters of texts."""
        out: list[np.ndarray] = []
        waiting: list[list] = []
        chars = 0
        for text in texts:
            parts: list = []
            waiting.append(parts)
            for piece in self._pieces(text or ""):
                parts.append(piece)
                chars += sum(map(len, piece)) if isinstance(piece, list) else 0
                if chars > CHUNK_CHARS:
                    self._resolve(waiting)
                    chars = 0
            if len(waiting) > 1 and chars == 0:
                out += [np.frombuffer(b"".join(p), "<u4") for p in waiting[:-1]]
                waiting = waiting[-1:]
        self._resolve(waiting)
        return out + [np.frombuffer(b"".join(p), "<u4") for p in waiting]

    def _resolve(self, waiting: list[list]) -> None:
        """Replace word lists and special ids by the bytes of their ids."""
        cache = self._cache
        words = set().union(*(x for parts in waiting for x in parts if isinstance(x, list)))
        new = [w for w in words if w not in cache]
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = list(words)
        for word, ids in zip(new, self.encode_words(new), strict=True):
            cache[word] = struct.pack(f"<{len(ids)}I", *ids)
        for parts in waiting:
            for i, x in enumerate(parts):
                if isinstance(x, list):
                    parts[i] = b"".join(map(cache.__getitem__, x))
                elif isinstance(x, int):
                    parts[i] = struct.pack("<I", x)

    def decode(self, ids: np.ndarray) -> str:
        """Token texts joined by blanks: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def loaded(source: str) -> WordBpe:
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(source)
    return _loaded[key]


def _source(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(documents: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of each text; ``vocabulary`` is the tokenizer file's path on the driver."""
    shared = documents.sparkSession.sparkContext.broadcast(_source(vocabulary))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = loaded(shared.value).encode_batch(batch.column(1).to_pylist())
        offsets = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"]
        )

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text of each row of ``encoded(doc_id, ids)``; null ids decode to the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(_source(vocabulary))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = loaded(shared.value)
        texts = [model.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_texts(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip_digests(
    documents: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids (little-endian uint32) and of the decoded text, encoding each text once."""
    shared = documents.sparkSession.sparkContext.broadcast(_source(vocabulary))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = loaded(shared.value)
        ids = model.encode_batch(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(model.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids], pa.string()),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
