"""Exact Jaccard join on word n-gram sets by prefix-tree verification.

1. Each text becomes its set of n-gram hashes.  Equal sets form one class (128-bit set
   digest), so exact copies are handled as one row from there on.
2. Which classes can meet at all is decided without comparing pairs.  Sets that reach
   the threshold differ in at most H tokens.  The hash range is cut into more than H
   parts; (part, content of the set in it) is an *item*, at most H items of either set
   are missing from the other, so two such sets share one of their first H + 1 items in
   any global order (rarest first, then most tokens, then hash).  Rarity is read from a table of fixed size
   that counts the n-grams of all documents by hash; passages that many documents
   share come last, so they hardly ever tie texts together that have little else in common.  The table only sets the order:
   links are exact for any counts.  Sizes are handled in overlapping
   geometric classes, so partners use the same number of parts.  For small sets every
   token is an item of its own.  Classes that share an item join the same block.
   Tasks reduce equal items to their least id before anything moves, so an item that a
   large part of all documents shares reaches its one bucket once per block of rows; items
   move sorted, 48 bits of each, packed by buckets.
3. Blocks are merged to candidate clusters by connected components (no pairs).  Chance meetings of short sets grow
   faster than the table and tie ever more clusters together, so large clusters are taken apart again: all items of
   their sets are counted exactly, and sets meet only by their first H + 1 items in the order of these counts.
   Items of one set only come first and bring nobody together, so a set with more than H of them is done.
4. Clusters of more than HEAVY_ROWS classes that are left are peeled: all members are compared with one
   pivot.  Members linked to it are connected, so pairs among them need no look any more.
   Jaccard distance obeys the triangle inequality: members whose distances to the pivot
   differ by more than the allowed distance cannot link, so a cluster falls into rings
   where only neighbouring rings meet.  A cluster that gains nothing stays as it is.
5. What remains is cut into chunks, and every pair of chunks that can hold a link not yet
   known is one bounded unit of work.  There, pairs that share too few items are told apart
   first; the rest, as sets in global hash order, is stored in a compressed trie.  Each set
   walks the trie once: branches share partial overlaps, a subtree is left as soon
   as the remaining lengths cannot reach the overlap that the threshold asks for, or when
   everything below it is known to be connected to the set already.
6. Components of the links found give the least id reachable.

Defined cases: null or blank texts have an empty set, link with nothing and are their own
component; rows with a null id come back with a null component; repeated rows come back
repeated, with the same component; other columns are ignored; an empty table gives an
empty result.  64-bit token hashes and 128-bit set digests are taken as identities.
``keep_one`` returns all columns of its rows, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hash_words, map_texts, mix, shingle_hashes, slices, utf8
from tidemark.sources.scratch import materialize
from tidemark.operators.components import connected_components

CHUNK_BYTES = 16 << 20
CHUNK_ROWS = 4_096
HEAVY_ROWS = 4_096
PIVOTS = 3
BITS_PER_ID = 8
MAX_BITS = 1 << 24
STAR_ITEMS = 1 << 19
KIND_ROWS = 256
ITEM_BITS = 48
BUCKET_ITEMS = 1 << 18
COUNTERS = 1 << 18
COUNT_BLOCK = 1 << 12
SMALL_SET = 64
_GOLD = 0x9E3779B97F4A7C15


class Limits:
    """Integer bounds that a Jaccard threshold num/den implies."""

    def __init__(self, threshold: float | Fraction):
        t = Fraction(threshold).limit_denominator(10_000)
        if not Fraction(1, 2) < t <= 1:
            raise ValueError("the threshold must be above 0.5 and at most 1")
        self.num, self.den = t.numerator, t.denominator
        self.classes = [SMALL_SET]
        while self.classes[-1] < 1 << 40:
            self.classes.append(-(-self.classes[-1] * self.den**3 // self.num**3) + 1)

    def needed(self, a: int, b: int) -> int:
        """Least overlap of sets of sizes a and b that reaches the threshold."""
        return -(-self.num * (a + b) // (self.den + self.num))

    def apart(self, a: int, b: int) -> int:
        """Most tokens in which such sets can differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def size_class(self, n: int) -> int:
        return int(np.searchsorted(self.classes, n))

    def parts(self, k: int) -> int:
        top = self.classes[k]
        return self.apart(top, top) * 3 // 2 + 16


def token_sets(texts: list, words: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; A-Z count as lower case."""
    hashes, at = hash_words([t.lower() for t in utf8(texts)])
    return [np.unique(shingle_hashes(hashes[at[i] : at[i + 1]], words)) for i in range(len(texts))]


def digest(tokens: np.ndarray) -> tuple[int, int]:
    first = int(mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64))
    second = int(mix(tokens * np.uint64(0xDA942042E4DD58B5) + np.uint64(7)).sum(dtype=np.uint64))
    return first - (1 << 63), second - (1 << 63)


def token_counts(documents: DataFrame, *, text_col: str, words: int) -> np.ndarray:
    """In how many rows the n-grams of each of COUNTERS hash groups occur, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for piece in slices(batch):
                spots = [(t % np.uint64(COUNTERS)).astype(np.int64) for t in token_sets(piece.column(0).to_pylist(), words)]
                total += np.bincount(np.concatenate(spots), minlength=COUNTERS)
        yield from packed(total.reshape(-1, COUNT_BLOCK))

    def packed(blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([zlib.compress(blocks[b].tobytes(), 1) for b in used], pa.binary())], names=["block", "counts"])

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(COUNT_BLOCK, np.int64)
        for data in rows.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(data), np.int64)
        return pa.table([pa.array([rows.column("block")[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["block", "counts"])

    parts = documents.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "block int, counts binary")
    # Sums of a block's rows in two steps, so no group grows with the number of tasks.
    some = parts.withColumn("salt", F.spark_partition_id() % 256).groupBy("block", "salt").applyInArrow(merge, "block int, counts binary")
    out = np.zeros((COUNTERS // COUNT_BLOCK, COUNT_BLOCK), np.int64)
    for r in some.groupBy("block").applyInArrow(merge, "block int, counts binary").collect():  # COUNTERS / COUNT_BLOCK rows
        out[r.block] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return out.ravel()


def commonness(counts: np.ndarray) -> np.ndarray:
    """A level for each hash group: 0 about the usual count, one more each time the excess over it doubles."""
    usual = np.median(counts)
    excess = np.maximum(counts - usual, 0) / (4 * np.sqrt(usual + 1))
    return np.ceil(np.log2(1 + excess)).astype(np.uint8)


def class_items(tokens: np.ndarray, k: int, limits: Limits, levels: np.ndarray | None = None) -> np.ndarray:
    """All items of a set in size class ``k``, in global order: rarest first, then most tokens, then by hash."""
    salt = np.uint64((k + 1) * _GOLD % (1 << 64))
    spread = mix(tokens ^ salt)
    level = np.zeros(len(tokens), np.uint8) if levels is None else levels[(tokens % np.uint64(len(levels))).astype(np.int64)]
    if k == 0:
        return spread[np.lexsort((spread, level))].view(np.int64)
    parts = limits.parts(k)
    part = ((spread >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    content = np.add.reduceat(mix(spread[order] + np.uint64(_GOLD)), begin)
    keys = mix(content ^ (part[begin] + np.uint64(1)) * salt)
    rare = np.minimum.reduceat(level[order], begin)  # an item is at most as common as its rarest token
    return keys[np.lexsort((keys, -np.diff(np.append(begin, len(tokens))), rare))].view(np.int64)


def items(tokens: np.ndarray, limits: Limits, levels: np.ndarray | None = None) -> np.ndarray:
    """The block keys of a set: its first H + 1 items in each size class that a partner may use."""
    n = len(tokens)
    if n == 0:
        return np.zeros(0, np.int64)
    largest = n * limits.den // limits.num
    take = limits.apart(n, largest) + 1
    return np.concatenate([class_items(tokens, k, limits, levels)[:take] for k in {limits.size_class(n), limits.size_class(largest)}])


def signatures(documents: DataFrame, *, id_col: str, text_col: str, words: int, limits: Limits) -> DataFrame:
    """doc_id, n, digest halves and block keys of every row."""
    levels = documents.sparkSession.sparkContext.broadcast(commonness(token_counts(documents, text_col=text_col, words=words)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = token_sets(batch.column(1).to_pylist(), words)
        halves = [digest(s) for s in sets]
        keys = [items(s, limits, levels.value) for s in sets]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([h[0] for h in halves], pa.int64()),
                pa.array([h[1] for h in halves], pa.int64()),
                pa.array([_list_bytes(k) for k in keys], pa.binary()),
            ],
            names=["doc_id", "n", "s1", "s2", "items"],
        )

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, run, "doc_id long, n long, s1 long, s2 long, items binary")


class _Node:
    __slots__ = ("children", "ends", "joined", "longest", "seg", "shortest")

    def __init__(self, seg: np.ndarray, size: int, joined: int):
        self.seg, self.shortest, self.longest, self.joined = seg, size, size, joined
        self.children: dict[int, _Node] = {}
        self.ends: list[int] = []


class Trie:
    """Sets in hash order; ``add`` links a set to the sets stored before it and stores it."""

    STEP = 48

    def __init__(self, limits: Limits):
        self.limits, self.root = limits, _Node(np.zeros(0, np.uint64), 0, -1)
        self.root.shortest, self.root.longest = 1 << 60, 0
        self.parent: list[int] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def member(self) -> int:
        self.parent.append(len(self.parent))
        return len(self.parent) - 1

    def _reach(self, a: int, passed: int, depth: int, overlap: int, node: _Node) -> bool:
        """Can any set below still reach the threshold with a set of size a?"""
        best = min(max(depth + a - passed, node.shortest), node.longest)
        return overlap + min(a - passed, best - depth) >= self.limits.needed(a, best)

    def probe(self, tokens: np.ndarray, me: int) -> None:
        a = len(tokens)
        stack = [(child, 0, 0) for child in self.root.children.values()]
        while stack:
            node, depth, overlap = stack.pop()
            if node.joined >= 0 and self.find(node.joined) == self.find(me):
                continue
            alive = True
            passed = 0
            for lo in range(0, len(node.seg), self.STEP):
                seg = node.seg[lo : lo + self.STEP]
                at = np.searchsorted(tokens, seg)
                overlap += int(np.count_nonzero(tokens[np.minimum(at, a - 1)] == seg))
                passed = int(np.searchsorted(tokens, seg[-1], "right"))
                depth += len(seg)
                if not self._reach(a, passed, depth, overlap, node):
                    alive = False
                    break
            if not alive:
                continue
            if node.ends and overlap >= self.limits.needed(a, depth):
                for other in node.ends:
                    self.union(other, me)
            stack.extend((child, depth, overlap) for child in node.children.values())

    def store(self, tokens: np.ndarray, me: int) -> None:
        node, at, size = self.root, 0, len(tokens)
        while True:
            node.shortest, node.longest = min(node.shortest, size), max(node.longest, size)
            if node.joined >= 0 and self.find(node.joined) != self.find(me):
                node.joined = -1
            if at == size:
                node.ends.append(me)
                return
            child = node.children.get(int(tokens[at]))
            if child is None:
                leaf = _Node(tokens[at:], size, me)
                leaf.ends.append(me)
                node.children[int(tokens[at])] = leaf
                return
            width = min(len(child.seg), size - at)
            differ = np.flatnonzero(child.seg[:width] != tokens[at : at + width])
            same = int(differ[0]) if len(differ) else width
            if same < len(child.seg):  # split the edge
                upper = _Node(child.seg[:same], size, child.joined)
                upper.shortest, upper.longest = child.shortest, child.longest
                child.seg = child.seg[same:]
                upper.children[int(child.seg[0])] = child
                node.children[int(tokens[at])] = upper
                child = upper
            node, at = child, at + same


def _tight_groups(sets: list[np.ndarray], colors: list[int | None], limits: Limits) -> list[list[int]]:
    """Groups of sets (ascending size) outside which no pair can reach the threshold.

    Sets that reach it share all but H of their items, so one of the first H + 1 items of each is common to
    both in any order; with the unit's rarest items first, what many sets share brings hardly any sets together.
    Pairs that meet are let through only if they share max(q, q') - H items.  Sets of one color are known to be
    connected; an item's list is left out once all its sets are in the prober's group already.
    """
    group = list(range(len(sets)))
    first: dict[int, int] = {}
    for i, color in enumerate(colors):
        if color is not None:
            group[i] = first.setdefault(color, i)

    def find(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    homes = [limits.size_class(len(t)) for t in sets]
    uppers = [len(t) * limits.den // limits.num for t in sets]
    kinds = [{k: np.sort(class_items(t, k, limits)) for k in {h, limits.size_class(u)}} for t, h, u in zip(sets, homes, uppers, strict=True)]
    every, times = np.unique(np.concatenate([v for ks in kinds for v in ks.values()]), return_counts=True)

    def rarest(me: int, k: int) -> list[int]:
        own = kinds[me][k]
        often = times[np.searchsorted(every, own)]
        order = np.lexsort((own, often))[: limits.apart(len(sets[me]), uppers[me]) + 1]
        return own[order[often[order] > 1]].tolist()  # an item of one set only brings none together

    lists: dict[int, list[int]] = {}
    same: dict[int, bool] = {}  # all sets of the list are in one group
    for me, tokens in enumerate(sets):
        home = homes[me]
        own = kinds[me][home]
        tried: set[int] = set()

        def look(others: Iterable[int]) -> None:
            for other in others:
                if other in tried or find(other) == find(me):
                    continue
                tried.add(other)
                theirs = kinds[other].get(home)
                if theirs is None:
                    continue
                at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                least = max(1, max(len(own), len(theirs)) - limits.apart(len(tokens), len(sets[other])))
                if np.count_nonzero(own[at] == theirs) >= least:
                    group[max(find(me), find(other))] = min(find(me), find(other))

        prefix = {k: rarest(me, k) for k in kinds[me]}
        met = [k for k in prefix[home] if k in lists]
        look(lists[k][-1] for k in met)
        for k in met:
            if not (same[k] and find(lists[k][0]) == find(me)):
                look(lists[k])
        for k in (x for v in prefix.values() for x in v):
            held = lists.setdefault(k, [])
            same[k] = same.get(k, True) and (not held or find(held[0]) == find(me))
            held.append(me)
    out: dict[int, list[int]] = {}
    for i in range(len(sets)):
        out.setdefault(find(i), []).append(i)
    return [g for g in out.values() if len(g) > 1]


def _unit(rows: list[tuple[int, int, int | None, np.ndarray]], cross: bool, limits: Limits) -> Iterator[tuple[int, int]]:
    """(id, least id linked within this unit); rows: (chunk, id, color, tokens). cross: only links between two chunks matter."""
    rows.sort(key=lambda r: (len(r[3]), r[1]))
    groups = [list(range(len(rows)))]
    if len(rows) > 2:
        groups = _tight_groups([r[3] for r in rows], [r[2] for r in rows], limits)
    for group in groups:
        if cross and len({rows[i][0] for i in group}) < 2:
            continue
        trie, ids, first = Trie(limits), [], {}
        for i in group:
            me = trie.member()
            ids.append(rows[i][1])
            if rows[i][2] is not None:
                trie.union(first.setdefault(rows[i][2], me), me)
            trie.probe(rows[i][3], me)
            trie.store(rows[i][3], me)
        least: dict[int, int] = {}
        for i, doc in enumerate(ids):
            root = trie.find(i)
            least[root] = min(doc, least.get(root, doc))
        for i, doc in enumerate(ids):
            if least[trie.find(i)] != doc:
                yield doc, least[trie.find(i)]


def _packed(tokens: np.ndarray) -> bytes:
    """Sorted tokens byte by byte, high bytes first: those hardly differ, so shuffles compress them."""
    return np.ascontiguousarray(tokens.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _tokens(col: pa.Array) -> list[np.ndarray]:
    planes = (np.frombuffer(x.as_buffer(), np.uint8).reshape(8, -1) for x in col)
    return [np.ascontiguousarray(p.T).view(">u8").ravel().astype(np.uint64) for p in planes]


def _trie_links(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """Rows (grp, ci, cj, chunk, rep, color, tokens) come sorted by unit; one unit is held at a time."""
    key, rows = None, []

    def done() -> pa.RecordBatch:
        links = list(_unit(rows, key[1] != key[2], limits))
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["src", "dst"]
        )

    for batch in batches:
        units = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        own = zip(*(batch.column(i).to_pylist() for i in range(3, 6)), _tokens(batch.column(6)), strict=True)
        for unit, row in zip(units, own, strict=True):
            if unit != key:
                if rows:
                    yield done()
                key, rows = unit, []
            rows.append(row)
    if rows:
        yield done()


def _short(items: np.ndarray) -> np.ndarray:
    """Items cut to ITEM_BITS: two that become equal only bring sets together that have no link."""
    return items.view(np.uint64) >> np.uint64(64 - ITEM_BITS)


def _list_bytes(items: np.ndarray) -> bytes:
    return np.ascontiguousarray(_short(items).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - ITEM_BITS // 8 :]).tobytes()


def _item_lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All items of a column of lists (or of bytes as `_list_bytes` makes them), and how many each row has."""
    if pa.types.is_list(col.type):
        return col.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(pc.list_value_length(col), np.int64)
    width = ITEM_BITS // 8
    raw = np.frombuffer(b"".join(x.as_buffer() for x in col), np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - width :] = raw
    return wide.view(">u8").ravel().astype(np.uint64), np.asarray(pc.binary_length(col), np.int64) // width


def _least(found: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each item once with its least id; the other ids of the items with those, each pair once."""
    order = np.lexsort((reps, found))
    found, reps = found[order], reps[order]
    first = np.concatenate((np.ones(min(1, len(found)), bool), found[1:] != found[:-1]))
    low = reps[first][np.cumsum(first) - 1] if len(found) else reps
    src, dst = reps[~first], low[~first]
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    new = (src != dst) & np.concatenate((np.ones(min(1, len(src)), bool), (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])))
    return found[first], reps[first], src[new], dst[new]


def _star_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, items) as (item, rep): the least id of each item; each other id meets it under a key of their own."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        found, reps, src, dst = _least(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        own = _short(mix(src.astype(np.uint64) ^ mix(dst.astype(np.uint64) + np.uint64(_GOLD))))
        keys, ids = np.concatenate((found, own, own)).view(np.int64), np.concatenate((reps, src, dst))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], names=["item", "rep"])

    size = 0
    for batch in batches:
        found, counts = _item_lists(batch.column(1))
        held.append((found, np.repeat(batch.column(0).to_numpy(), counts)))
        size += len(found)
        if size >= STAR_ITEMS:
            yield flush()
            size = 0
    if held:
        yield flush()


def _star_buckets(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows of `_star_rows`, items of ITEM_BITS, by buckets, which are ranges of items: their gaps and ids, byte by byte as in `_packed`."""
    for batch in _star_rows(batches):
        keys, ids = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64)
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        bucket = ((keys >> np.uint64(ITEM_BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)
        used, starts = np.unique(bucket, return_index=True)
        gaps = np.diff(keys, prepend=np.uint64(0))
        gaps[starts] = keys[starts]
        spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)) if len(keys) else []
        packs = [pa.array([_packed(x[a:b]) for a, b in spans], pa.binary()) for x in (gaps, ids)]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *packs], names=["bucket", "items", "reps"])


def _met(lists: DataFrame, tokens: int, limits: Limits) -> DataFrame:
    """(src, dst): each id that shares an item with a lesser one, with the least such id of that item.  ``tokens``: of all sets, about."""
    items = 2 * limits.apart(tokens, tokens * limits.den // limits.num)
    partitions = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(1 << 30, max(items // BUCKET_ITEMS, 4 * partitions))

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        found = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in _tokens(rows.column("items"))])
        reps = np.concatenate(_tokens(rows.column("reps"))).view(np.int64)
        _, _, src, dst = _least(found, reps)
        return pa.table([pa.array(src), pa.array(dst)], names=["src", "dst"])

    stars = lists.mapInArrow(lambda batches: _star_buckets(batches, buckets), "bucket int, items binary, reps binary")
    return stars.groupBy("bucket").applyInArrow(meet, "src long, dst long")


def _bits(ids: int) -> int | None:
    """Size of a bitmap for so many ids; None where it would exceed MAX_BITS."""
    bits = 1 << max(17, (BITS_PER_ID * ids - 1).bit_length())
    return bits if bits <= MAX_BITS else None


def _bit_rows(ids: DataFrame, bits: int, names: tuple[str, str]) -> DataFrame:
    """The ids (column ``rep``) as a bitmap, in rows of 32 bits."""
    spot = f"pmod(rep, {bits})"
    rows = ids.selectExpr(f"shiftright({spot}, 5) AS {names[0]}", f"shiftleft(1L, cast({spot} & 31 AS int)) AS {names[1]}")
    return rows.groupBy(names[0]).agg(F.bit_or(names[1]).alias(names[1]))


def _regrouped(heavy: DataFrame, sets: DataFrame, limits: Limits) -> DataFrame:
    """rep, n and grp of the rows of large clusters that can still link: they meet by their rarest items, counted exactly.

    Up to H + 1 items of each set are looked at, as in `items`; those that no other set has take the first places.
    """

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, KIND_ROWS):
                piece = batch.slice(at, KIND_ROWS)
                reps, kind, places, held = [], [], [], []
                for rep, tokens in zip(piece.column(0).to_pylist(), _tokens(piece.column(1)), strict=True):
                    largest = len(tokens) * limits.den // limits.num
                    for k in {limits.size_class(len(tokens)), limits.size_class(largest)}:
                        own = _short(class_items(tokens, k, limits)).view(np.int64)
                        reps.append(rep)
                        kind.append(k)
                        places.append(limits.apart(len(tokens), largest) + 1 - len(own))
                        held.append(own)
                ends = np.cumsum([0] + [len(x) for x in held]).astype(np.int32)
                flat = np.concatenate(held) if held else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reps, pa.int64()), pa.array(kind, pa.int32()), pa.array(places, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["rep", "kind", "places", "items"],
                )

    rows = sets.select("rep", "tokens").mapInArrow(kinds, "rep long, kind int, places long, items array<long>").select("rep", "kind", "places", F.explode("items").alias("item"))
    often = rows.groupBy("item").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    # With s items that others have too, the others' places are taken: places left are H + 1 - (all items - s).
    shared = rows.join(often.hint("merge"), "item").groupBy("rep", "kind", "places").agg(F.array_sort(F.collect_list(F.struct("times", "item"))).alias("shared"))
    first = shared.withColumn("left", F.col("places") + F.size("shared")).where(F.col("left") > 0).select("rep", F.slice(F.col("shared")["item"], 1, F.col("left").cast("int")).alias("items"))
    tokens = heavy.agg(F.sum("n")).first()[0] or 0
    groups = connected_components(_met(first, tokens, limits)).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    return heavy.select("rep", "n").join(groups, "rep")


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that the table lacks."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _columns(df: DataFrame) -> list:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def _split(rows: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows surely not among ``ids`` (column ``rep``), and those that may be: by a bitmap, all of them where it would grow too large."""
    bits = _bits(ids.count())
    if bits is None:
        return rows.limit(0), rows
    spot, (w, b) = f"pmod({id_col}, {bits})", (_fresh(rows, "word_"), _fresh(rows, "bits_"))
    marked = rows.withColumn(w, F.expr(f"shiftright({spot}, 5)")).join(F.broadcast(_bit_rows(ids, bits, (w, b))), w, "left")
    maybe = F.expr(f"coalesce((shiftright({b}, cast({spot} & 31 AS int)) & 1) = 1, false)")
    return marked.where(~maybe).select(*_columns(rows)), marked.where(maybe).select(*_columns(rows))


def _sets_of(rows: DataFrame, places: DataFrame, words: int) -> DataFrame:
    """``places`` (rep, digest halves and more) with the tokens of their documents.

    Texts, which compress better than tokens, are what moves to meet the places; a bitmap of the ids spares the texts
    that surely have none, while it stays small enough.
    """
    _, maybe = _split(rows.where("doc_id IS NOT NULL"), "doc_id", places)
    joined = maybe.withColumnRenamed("doc_id", "rep").join(places, "rep")
    at = {c: i for i, c in enumerate(joined.columns)}

    def fetch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = token_sets(batch.column(at["text"]).to_pylist(), words)
        want = zip(batch.column(at["s1"]).to_pylist(), batch.column(at["s2"]).to_pylist(), strict=True)
        same = pa.array([digest(s) == w for s, w in zip(sets, want, strict=True)], pa.bool_())  # a repeated id may have other texts
        columns = list(batch.columns)
        columns[at["text"]] = pa.array([_packed(s) for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays(columns, names=[*at]).filter(same)

    schema = ", ".join(f"{f.name} {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in joined.schema)
    return map_texts(joined, fetch, schema).withColumnRenamed("text", "tokens")


_UNIT = ["grp", "ci", "cj", "chunk", "rep", "color", "tokens"]
_STATE = "rep long, n long, grp long, color long, upper boolean"


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (state, pivot, tokens, its tokens) as (state, pivot, pn, overlap)."""
    for batch in batches:
        pns, both = [], []
        for own, theirs in zip(_tokens(batch.column(6)), _tokens(batch.column(7)), strict=True):
            at = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
            pns.append(len(theirs))
            both.append(int(np.count_nonzero(theirs[at] == own)))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:6], pa.array(pns, pa.int64()), pa.array(both, pa.int64())],
            names=["rep", "n", "grp", "color", "upper", "pivot", "pn", "overlap"],
        )


def _peel(state: DataFrame, sets: DataFrame, limits: Limits, heavy_rows: int) -> tuple[DataFrame, DataFrame]:
    """Links of the members of heavy groups to pivots, and the rows whose pairs are still open.

    ``color``: a pivot that the row is linked to.  ``upper``: pairs of two such rows are looked at in another group.
    """
    num, den = limits.num, limits.den
    links, done = None, None
    for turn in range(PIVOTS):
        sizes = state.groupBy("grp").agg(F.count_if(F.col("color").isNull()).alias("open"))
        rest = state.join(sizes.where(F.col("open") <= heavy_rows).select("grp"), "grp").select(*state.columns)
        done = rest if done is None else done.unionByName(rest)
        state = state.join(sizes.where(F.col("open") > heavy_rows).select("grp"), "grp").select(*state.columns)
        if state.isEmpty():
            return links, done
        pivots = state.where("color IS NULL").groupBy("grp").agg(F.min_by("rep", F.struct(F.xxhash64("rep", F.lit(turn)), "rep")).alias("pivot"))
        theirs = pivots.join(sets, F.col("pivot") == F.col("rep")).groupBy("grp", "pivot").agg(F.first("tokens").alias("p_tokens"))
        measured = (
            state.join(sets, "rep").join(theirs, "grp").select(*state.columns, "pivot", "tokens", "p_tokens")
            .mapInArrow(_overlaps, f"{_STATE}, pivot long, pn long, overlap long")
        )
        union = F.expr("n + pn - overlap")
        measured = measured.withColumn("linked", F.lit(num) * union <= F.lit(den) * F.col("overlap")).withColumn(
            "ring", F.expr(f"((n + pn - 2 * overlap) * {den}L) DIV ((n + pn - overlap) * {den - num}L)") if den > num else F.when(F.col("linked"), 0).otherwise(2).cast("long")
        )
        measured = materialize(measured.drop("pn", "overlap"), "rings")
        new = measured.where("linked AND rep <> pivot").select(F.col("rep").alias("src"), F.col("pivot").alias("dst"))
        links = new if links is None else links.unionByName(new)
        near = F.filter(F.array(F.col("ring") - 1, F.col("ring")), lambda g: g >= 0)
        parts = measured.select("grp", F.explode(near).alias("g")).groupBy("grp", "g").count()
        gain = measured.groupBy("grp").agg(F.count("*").alias("all"), F.count_if("linked").alias("got")).join(
            parts.groupBy("grp").agg(F.max("count").alias("most")), "grp"
        )
        d = measured.join(gain, "grp").withColumn("color", F.coalesce("color", F.when(F.col("linked"), F.col("pivot"))))
        split = F.col("most") * 2 <= F.col("all")
        cut = d.where(split).withColumn("g", F.explode(near)).select(
            "rep", "n", F.xxhash64("grp", "g", F.lit(turn)).alias("grp"), "color", (F.col("ring") > F.col("g")).alias("upper")
        )
        whole = d.where(~split)
        again = F.col("got") * 4 >= F.col("all")
        done = done.unionByName(whole.where(~again).select(*state.columns))
        state = materialize(cut.unionByName(whole.where(again).select(*state.columns)), "peeled")
    return links, done.unionByName(state)


def _units(state: DataFrame, chunk_bytes: int) -> DataFrame:
    """rep, color and the units (grp, ci, cj, chunk) of the rows with open pairs, each unit a pair of bounded chunks."""
    kind = F.xxhash64("color", "upper")
    many = F.greatest(F.ceil(F.count("*") / F.lit(CHUNK_ROWS)), F.ceil(F.sum("n") * 8 / F.lit(chunk_bytes)))
    parts = state.groupBy("grp", kind.alias("kind")).agg(F.first("color").alias("color"), F.first("upper").alias("upper"), many.cast("long").alias("chunks"))
    # at most two parts for each pivot of a group and two without
    plan = parts.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("kind", F.col("color").alias("c"), F.col("upper").alias("u"), "chunks"))).alias("plan"))
    d = state.withColumn("kind", kind).join(plan, "grp")
    d = d.withColumn("at", F.array_position(F.transform("plan", lambda x: x["kind"]), F.col("kind")).cast("int"))
    wide = F.lit(1 << 32)
    own = F.col("at") * wide + F.pmod(F.xxhash64("rep"), F.element_at("plan", F.col("at"))["chunks"])

    def chunks(x, i):
        known = (x["u"] & F.col("upper")) | F.coalesce(x["c"] == F.col("color"), F.lit(False))
        return F.when(known, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), x["chunks"] - 1), lambda s: (i + 1) * wide + s))

    d = d.withColumn("chunk", own).withColumn("other", F.explode(F.flatten(F.transform("plan", chunks))))
    return d.select("rep", "color", "grp", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"), "chunk")


def similar_documents(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    threshold: float | Fraction = Fraction(4, 5),
    chunk_bytes: int = CHUNK_BYTES,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable by links)."""
    limits = Limits(threshold)
    sig = materialize(signatures(documents, id_col=id_col, text_col=text_col, words=words, limits=limits), "sig")
    classes = materialize(
        sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "classes"
    )
    reps = classes.select(F.col("rep").alias("doc_id"), "s1", "s2")
    known = sig.where("n > 0").select("doc_id", "s1", "s2").join(classes.select("s1", "s2", "rep"), ["s1", "s2"])
    copies = materialize(known.where("doc_id > rep").select(F.col("doc_id").alias("rep")).distinct(), "equal")
    # Item lists move only for rows in the bitmap of the ids that equal sets make superfluous.
    sure, maybe = _split(sig.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "s1", "s2", "items"), "doc_id", copies)
    lists = sure.unionByName(maybe.join(reps, ["doc_id", "s1", "s2"], "left_semi")).select("doc_id", "items")
    near = _met(lists, classes.agg(F.sum("n")).first()[0] or 0, limits)
    clusters = connected_components(near).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    clusters = materialize(clusters.hint("merge").join(classes, "rep"), "clusters")

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sizes = clusters.groupBy("grp").agg(((F.count("*") > heavy_rows) | (F.sum("n") * 8 > chunk_bytes)).alias("heavy"))
    marked = materialize(clusters.join(sizes, "grp"), "marked")
    light, heavy = marked.where("NOT heavy"), marked.where("heavy")
    units = light.select("rep", "s1", "s2", F.lit(None).cast("long").alias("color"), "grp", *[F.lit(0).cast("long").alias(c) for c in ("ci", "cj", "chunk")])
    sets = _sets_of(rows, units, words).select(*_UNIT)
    known = None
    if not heavy.isEmpty():
        large = materialize(_sets_of(rows, heavy.select("rep", "s1", "s2"), words).select("rep", "tokens"), "sets")
        regrouped = materialize(_regrouped(heavy, large, limits), "regrouped")
        state = regrouped.select("rep", "n", "grp", F.lit(None).cast("long").alias("color"), F.lit(False).alias("upper"))
        known, state = _peel(state, large, limits, heavy_rows)
        sets = sets.unionByName(_units(state, chunk_bytes).join(large, "rep").select(*_UNIT))
    links = (
        sets.repartition("grp", "ci", "cj")
        .sortWithinPartitions("grp", "ci", "cj")
        .mapInArrow(lambda b: _trie_links(b, limits), "src long, dst long")
    )
    if known is not None:
        links = links.unionByName(known)
    found = connected_components(links).select(F.col("node").alias("rep"), "component")
    named = classes.select("s1", "s2", "rep").join(found.hint("merge"), "rep", "left").select(
        "s1", "s2", F.coalesce("component", "rep").alias("component")
    )
    out = sig.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))).alias("component_id"),
    )


def keep_one(documents: DataFrame, *, words: int = 5, threshold: float | Fraction = Fraction(4, 5)) -> DataFrame:
    """The documents without those whose component has a smaller id; rows with a null id stay."""
    found = similar_documents(documents, words=words, threshold=threshold)
    copies = materialize(found.where("component_id < doc_id").select(F.col("doc_id").alias("rep")).distinct(), "copies")
    # Documents outside the bitmap of the removed ids surely stay and aren't shuffled; the others meet the ids themselves.
    sure, rest = _split(documents, "doc_id", copies)
    gone = _fresh(documents, "gone_")
    left = rest.join(copies.withColumnRenamed("rep", gone), F.col("doc_id") == F.col(gone), "left_anti")
    return sure.unionByName(left)
