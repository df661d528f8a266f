"""Alignment of the tokens of two tokenizers over the same bytes.

A page is some hundred documents.  The byte ends of all its tokens, document after document, form two rising
arrays.  Where both tokenizers cut alike for a stretch, the arrays are equal at a fixed shift of their indices: stretches
are compared as blocks of memory whose length doubles until they differ, and the end of the stretch is found by bisection.
Where they differ, the tokens up to the next common end form one irregular group; it is walked token by token, and the
shift changes by it.  Document borders are common ends, so groups never cross them.

Tokens are linked if their bytes overlap.  Inside a group the links follow one elementary interval after the other, so
there are as many as ends.  How often two ids are linked corpus-wide is counted in two steps (inside pages, then by
Spark), written to the shared folder, and brought back to the pages in blocks of at most ``BLOCK_PAIRS`` id pairs:
a task holds one block and one page at a time, whatever the size of the corpus and the vocabularies.

Texts are encoded once.  Pages are kept in the shared folder: links as distinct (pair, document) with their numbers.
Both libraries are the tokenizers' own; texts of well-known letters take a faster encoder with the same vocabulary.

Defined cases: null and empty texts, and texts whose tokens don't give back the blank and the text, have no tokens (zeros); a null id
keeps its row; repeated rows count each; strings of special tokens are plain text; very long texts are pages of their own;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WELL_KNOWN, mix, slices
from tidemark.sources.scratch import materialize

BLOCK_PAIRS = 4_000_000
PROBE = 8
_ONES = b"\x01" * (1 << 16)
_loaded: dict[tuple, Pair] = {}


def _byte_of_letter() -> dict[str, int]:
    """The byte that each printable letter stands for in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers of a worker, with the bytes of all their tokens."""

    def __init__(self, a_source: str, b_model: bytes | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_source)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        letters = _byte_of_letter()
        size = self.a.get_vocab_size()
        self.a_bytes = [b""] * size
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        ranks = {self.a_bytes[i]: i for t, i in self.a.get_vocab().items() if t not in special}
        self.fast = tiktoken.Encoding("a", pat_str=GPT_PATTERN, mergeable_ranks=ranks, special_tokens={}) if _splits_by_pattern(a_source) else None
        self.b_bytes = []
        self.b = SentencePieceProcessor(model_proto=b_model) if b_model else None
        for i in range(self.b.get_piece_size() if b_model else 0):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        if max(size, len(self.b_bytes)) >= 1 << 16:
            raise ValueError("vocabularies of 65 536 tokens and more aren't supported")
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int32) for table in (self.a_bytes, self.b_bytes))
        self.a_digits, self.b_digits = _digits(size), _digits(len(self.b_bytes))

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text by both; none where their bytes don't give back the blank and the text."""
        asked = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in asked]
        a: list[list[int]] = [[] for _ in texts]
        b: list[list[int]] = [[] for _ in texts]
        for i, x, y in zip(asked, self._encode_a([" " + t for t in some]), self.b.encode(some, num_threads=1) if some else [], strict=True):
            want = (" " + texts[i]).encode()
            if b"".join(map(self.a_bytes.__getitem__, x)) == want and b"".join(map(self.b_bytes.__getitem__, y)) == want:
                a[i], b[i] = x, y
        return a, b

    def counts(self, texts: list[str | None]) -> list[int]:
        """How many tokens of A each text has."""
        return [len(x) for x in self._encode_a([t or "" for t in texts])]

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        known = [self.fast is not None and WELL_KNOWN.fullmatch(t) is not None for t in texts]
        rest = iter(self.a.encode_batch_fast([t for t, k in zip(texts, known, strict=True) if not k], add_special_tokens=False))
        return [self.fast.encode_ordinary(t) if k else next(rest).ids for t, k in zip(texts, known, strict=True)]


#: Fixed value: how byte-level vocabularies of this kind cut texts into words.
GPT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _splits_by_pattern(source: str) -> bool:
    spec = json.loads(source)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    model = spec["model"]
    return bool(plain and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges") and _ranked(model))


def _ranked(model: dict) -> bool:
    """Whether ids follow the order of the merges, so that an id is its rank."""
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    return all(x < y for x, y in zip(made, made[1:], strict=False))


def _digits(n: int) -> np.ndarray:
    """Decimal forms of the numbers below n, five bytes each, left padded with zero bytes."""
    out = np.zeros((n, 5), np.uint8)
    value = np.arange(n)
    for place in range(5):
        digit = value // 10**place
        out[:, 4 - place] = np.where((digit > 0) | (place == 0), 48 + digit % 10, 0)
    return out


def loaded(a_source: str, b_model: bytes | None) -> Pair:
    """The pair of this worker; without a model for B, for counting only."""
    key = hashlib.sha256(a_source.encode()).digest(), hashlib.sha256(b_model or b"").digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pair(a_source, b_model)
    return _loaded[key]


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of A and of B end where one of the other ends too (as booleans).

    Both arrays rise strictly and have the same last value.
    """
    na, nb = len(ends_a), len(ends_b)
    la, lb = ends_a.tolist(), ends_b.tolist()
    ba, bb = ends_a.astype("<i8").tobytes(), ends_b.astype("<i8").tobytes()
    closes_a, closes_b = bytearray(na), bytearray(nb)
    i = j = 0
    while i < na:
        x, y = la[i], lb[j]
        if x == y:
            # A one-to-one stretch at this shift of indices: probe blocks that double, then bisect the one that differs.
            most = min(na - i, nb - j)
            good, step = 1, PROBE
            while good < most:
                stop = min(good + step, most)
                if ba[8 * (i + good) : 8 * (i + stop)] == bb[8 * (j + good) : 8 * (j + stop)]:
                    good, step = stop, 2 * step
                    continue
                while stop - good > 1:
                    mid = (good + stop) // 2
                    if ba[8 * (i + good) : 8 * (i + mid)] == bb[8 * (j + good) : 8 * (j + mid)]:
                        good = mid
                    else:
                        stop = mid
                break
            ones = _ONES[:good] if good <= len(_ONES) else b"\x01" * good
            closes_a[i : i + good] = ones
            closes_b[j : j + good] = ones
            i += good
            j += good
            continue
        while x != y:  # an irregular group: on to the next common end
            if x < y:
                i += 1
                x = la[i]
            else:
                j += 1
                y = lb[j]
        closes_a[i] = closes_b[j] = 1
        i += 1
        j += 1
    return np.frombuffer(closes_a, bool), np.frombuffer(closes_b, bool)


class Aligned:
    """The alignment of a page: tokens of all documents, one after the other."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        a, b = pair.encode(texts)
        self.pair, self.docs = pair, len(texts)
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        self.a, self.b = (np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())) for ids, n in ((a, self.n_a), (b, self.n_b)))
        self.ends_a, self.ends_b = np.cumsum(pair.a_size[self.a], dtype=np.int64), np.cumsum(pair.b_size[self.b], dtype=np.int64)
        self.closes_a, self.closes_b = common_ends(self.ends_a, self.ends_b)
        # The group of each token; offsets of documents in tokens and groups.
        self.group_a = np.cumsum(self.closes_a) - self.closes_a
        self.group_b = np.cumsum(self.closes_b) - self.closes_b
        self.at_a, self.at_b = (np.concatenate(([0], np.cumsum(n))) for n in (self.n_a, self.n_b))
        closed = np.concatenate(([0], np.cumsum(self.closes_a)))
        self.at_group = closed[self.at_a]
        self.n_groups = np.diff(self.at_group)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, A id, B id) of each link."""
        total = int(self.ends_a[-1]) if len(self.ends_a) else 0
        from_a, ends = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        from_a[self.ends_a] = True
        ends[self.ends_a] = ends[self.ends_b] = True
        at = np.flatnonzero(ends)
        by_a = from_a[at]
        from_a[:] = False
        from_a[self.ends_b] = True
        by_b = from_a[at]
        i, j = np.cumsum(by_a) - by_a, np.cumsum(by_b) - by_b
        doc = np.repeat(np.arange(self.docs), self.n_a)
        return doc[i], self.a[i], self.b[j]

    def group_texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each document: decimal ids in order."""
        na, nb = len(self.a), len(self.b)
        letters = np.zeros((na + nb, 6), np.uint8)
        # A token stands after all of A before it and the B tokens of earlier groups; a B token after all A tokens of its group.
        done_a, done_b = np.flatnonzero(self.closes_a) + 1, np.flatnonzero(self.closes_b) + 1
        place_a = np.arange(na) + np.concatenate(([0], done_b))[self.group_a]
        place_b = np.arange(nb) + done_a[self.group_b] if nb else np.zeros(0, np.int64)
        letters[place_a, :5] = self.pair.a_digits[self.a]
        letters[place_b, :5] = self.pair.b_digits[self.b]
        letters[place_a, 5] = np.where(self.closes_a, ord("|"), ord(","))
        letters[place_b, 5] = np.where(self.closes_b, ord(";"), ord(","))
        flat = letters.ravel()
        used = flat != 0
        upto = np.concatenate(([0], np.cumsum(used.reshape(-1, 6).sum(axis=1), dtype=np.int64)))
        joined = flat[used].tobytes()
        bounds = upto[self.at_a + self.at_b]
        return [joined[s : e - 1] if e > s else b"" for s, e in zip(bounds, bounds[1:], strict=False)]

    def groups(self) -> list[list[dict]]:
        """The groups of each document as lists of ids."""
        a, b = self.a.tolist(), self.b.tolist()
        done_a, done_b = (np.concatenate(([0], np.flatnonzero(c) + 1)).tolist() for c in (self.closes_a, self.closes_b))
        return [
            [{"a": a[done_a[g] : done_a[g + 1]], "b": b[done_b[g] : done_b[g + 1]]} for g in range(s, e)]
            for s, e in zip(self.at_group.tolist(), self.at_group[1:].tolist(), strict=False)
        ]


def _sources(a_path: str, b_path: str) -> tuple[str, bytes]:
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        return f.read(), g.read()


def _rows(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def align(documents: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, groups: array of (ids of A, ids of B) between common ends.  The paths are files on the driver."""
    shared = documents.sparkSession.sparkContext.broadcast(_sources(a_path, b_path))
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found = Aligned(loaded(*shared.value), piece.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found.groups(), kind)], names=["doc_id", "groups"])

    return _rows(documents, id_col, text_col).mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def with_token_counts(documents: DataFrame, a_path: str, *, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """``documents`` without its text, and with the number of A's tokens of each text (0 for a null one)."""
    with open(a_path, encoding="utf-8") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    at, rest = documents.columns.index(text_col), [c for c in documents.columns if c not in (text_col, name)]
    kept = [documents.columns.index(c) for c in rest]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*rest).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                counts = loaded(shared.value, None).counts(piece.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in kept], pa.array(counts, pa.int64())], names=[*rest, name])

    return documents.mapInArrow(run, f"{kinds + ', ' if rest else ''}{name} long")


_DOCS = "doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, digests array<string>"
#: pairs: sorted distinct (A id << 16 | B id); totals: links of each in the page; spread: documents of each; docs, links: of each (pair, document).
_LINKS = "pairs binary, totals binary, spread binary, docs binary, links binary"


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32 byte by byte, all lowest bytes first: the upper ones, mostly zero, compress to nothing."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _pages(documents: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(_sources(a_path, b_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        page = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch):
                found = Aligned(loaded(*shared.value), piece.column(1).to_pylist())
                doc, a, b = found.links()
                key, links = np.unique((a << 16 | b) << 31 | doc, return_counts=True)
                pair, docs = key >> 31, key & 0x7FFFFFFF
                first = np.flatnonzero(np.diff(pair, prepend=-1))
                totals = np.add.reduceat(links, first) if len(first) else links
                digests = [hashlib.sha256(x).hexdigest() if x else "" for x in found.group_texts()]
                numbers = (found.n_a, found.n_b, found.n_groups, found.n_a + found.n_b - found.n_groups)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([page], pa.int64()), pa.array([piece.column(0).to_pylist()], pa.list_(pa.int64())),
                        *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in numbers], pa.array([digests], pa.list_(pa.string())),
                        *[pa.array([_planes(x)], pa.binary()) for x in (np.diff(pair[first], prepend=0), totals, np.diff(first, append=len(pair)), docs, links)],
                    ],
                    names=["page", *(c.split()[0] for c in f"{_DOCS}, {_LINKS}".split(", "))],
                )
                page += 1

    return _rows(documents, id_col, text_col).mapInArrow(run, f"page long, {_DOCS}, {_LINKS}")


def link_counts(pages: DataFrame) -> DataFrame:
    """a, b, n (links corpus-wide), best (whether no other A id is linked more often with this B id)."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = np.cumsum(_numbers(pairs))
                yield pa.RecordBatch.from_arrays([pa.array(keys >> 16), pa.array(keys & 0xFFFF), pa.array(_numbers(n))], names=["a", "b", "n"])

    counts = pages.select("pairs", "totals").mapInArrow(totals, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "link-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each B id
    return counts.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _block_of(pairs: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(pairs.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def _met(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """page, doc (its place there) and all its columns, with sums over its links: each page meets each block of counts."""
    size = counts.count()
    blocks = -(-size // BLOCK_PAIRS) or 1
    whole = pages.agg(F.count(F.lit(1)), F.sum(F.length("pairs") + F.length("docs"))).first()
    # A slot is a copy of a block and the pages that meet it there, about twice its size.
    bytes_a_page = (whole[1] or 0) // max(1, whole[0]) // blocks + 1
    slots = max(1, -(-whole[0] // max(1, 2 * 17 * (size // blocks) // bytes_a_page)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, best = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            pair = a << 16 | b
            block = _block_of(pair, blocks)
            for k in np.unique(block).tolist():
                mine = block == k
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k]), *[pa.array([x[mine].astype("<i8").tobytes()], pa.binary()) for x in (pair, n << 1 | best)]],
                    names=["block", "pairs", "totals"],
                )

    table = counts.mapInArrow(packed, "block long, pairs binary, totals binary")
    table = table.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("page", F.lit(-1).cast("long"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A page's links by blocks; block 0 carries the columns of its documents."""
        for batch in batches:
            for r in batch.to_pylist():
                pairs, spread = np.cumsum(_numbers(r["pairs"])), _numbers(r["spread"])
                docs, links = _numbers(r["docs"]), _numbers(r["links"])
                block = _block_of(pairs, blocks)
                owner = np.repeat(block, spread)
                for k in range(blocks):
                    mine, own = block == k, owner == k
                    if k and not mine.any():
                        continue
                    row = r if k == 0 else dict.fromkeys(r) | {"page": r["page"]}
                    values = {"block": k, "pairs": _planes(np.diff(pairs[mine], prepend=0)), "totals": None, "spread": _planes(spread[mine]), "docs": _planes(docs[own]), "links": _planes(links[own])}
                    yield pa.RecordBatch.from_pylist([{n: (row | values)[n] for n in names}], schema=kind)

    names = ["block", *pages.columns]
    kind = pa.schema(
        [("block", pa.int64()), ("page", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *[(c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links")],
         ("digests", pa.list_(pa.string())), *[(c.split()[0], pa.binary()) for c in _LINKS.split(", ")]]
    )
    pieces = pages.mapInArrow(cut, f"block long, page long, {_DOCS}, {_LINKS}").withColumn("slot", F.pmod(F.xxhash64("page"), F.lit(slots)).cast("int"))
    both = table.unionByName(pieces, allowMissingColumns=True)
    columns = both.columns

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a slot in order: its block of counts, then its pages."""
        at, parts, keys, values = None, [], None, None
        for batch in batches:
            for k in range(batch.num_rows):
                r = {n: batch.column(i)[k].as_py() for i, n in enumerate(columns)}
                if (r["block"], r["slot"]) != at:
                    at, parts, keys = (r["block"], r["slot"]), [], None
                if r["page"] < 0:
                    parts.append((np.frombuffer(r["pairs"], "<i8"), np.frombuffer(r["totals"], "<i8")))
                    continue
                if keys is None:
                    keys, values = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
                    order = np.argsort(keys)
                    keys, values, parts = keys[order], values[order], []
                pairs, spread, docs, links = np.cumsum(_numbers(r["pairs"])), _numbers(r["spread"]), _numbers(r["docs"]), _numbers(r["links"])
                n = int(docs.max()) + 1 if len(docs) else 0
                found = np.repeat(values[np.searchsorted(keys, pairs)], spread) if len(pairs) else docs
                sums, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
                np.add.at(sums, docs, links * (found >> 1))
                np.add.at(best, docs, links * (found & 1))
                rows = max(n, len(r["doc_ids"] or ()))
                pad = lambda x: x.tolist() + [0] * (rows - len(x))
                fill = lambda x: x or [None] * rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["page"]] * rows, pa.int64()), pa.array(range(rows), pa.int64()),
                     *[pa.array(fill(r[c]), pa.int64()) for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")], pa.array(pad(best), pa.int64()),
                     pa.array(pad(sums), pa.int64()), pa.array(fill(r["digests"]), pa.string())],
                    names=["page", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    dealt = both.repartition("block", "slot").sortWithinPartitions("block", "slot", "page")
    return dealt.mapInArrow(meet, "page long, doc long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def alignment_digests(documents: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    ``n_best`` are the links whose pair is the corpus-wide most frequent of its B id, ``count_sum`` adds up the
    corpus-wide counts of all its links.
    """
    pages = materialize(_pages(documents, a_path, b_path, id_col, text_col), "aligned-pages")
    counts = materialize(link_counts(pages), "link-counts")
    met = _met(pages, counts)
    one = [F.max(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    sums = [F.sum(c).alias(c) for c in ("n_best", "count_sum")]
    return met.groupBy("page", "doc").agg(*one, *sums, F.max("groups_sha256").alias("groups_sha256")).drop("page", "doc")
