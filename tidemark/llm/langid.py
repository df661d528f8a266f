"""Language identification of mixed-language text.

Letters are grouped to words; a word's script (Unicode ranges) narrows the languages
to those that use it, character trigrams with word ends score it for each of them, and a
Viterbi pass with a penalty per switch labels the words.  Runs of equal labels are the spans;
the document's language has the most letters, its score is their share.

The pass is exact for any length: texts are cut into chunks of words, all chunks of a batch
compute the best score from every first to every last language at once, chunks are chained,
and then all chunks are traced back at once.

Training counts trigrams of labelled rows; ``max_train`` bounds the sample (rows of the
smallest hashes of the id): each language has its share of it, rare ones at least the
``RARE``-th part of an equal share, and all their rows where they have fewer.  Tables have ``BUCKETS`` rows whatever the corpus.

Scores are held for about ``BLOCK_FLOATS`` words x languages at a time; longer texts
are passed segment by segment, forwards for the best scores and backwards for the labels.

Defined cases: null texts and texts without letters are ``und`` with score 0; ties go to the language
with more training letters, then by name; null ids and repeated rows keep their rows; without any
labelled row all is ``und``; very long texts are read whole in segments; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import filter_texts, map_texts, slices

BUCKETS = 1 << 15
MAX_TRAIN = 20_000
MAX_LANGUAGES = 256
SWITCH = 6.0
MIN_SCORE = 0.35
CHUNK = 64
RARE = 4
HASHES = 1 << 40
BLOCK_FLOATS = 1 << 24
SEGMENT_CHARS = 1 << 20
_FAR = np.float32(-1e9)

# First code points of script ranges (Unicode blocks) and their scripts.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS])
_letters: list[np.ndarray] = []
_NO_LETTER = re.compile(r"[\W\d_]")


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


@dataclass
class Model:
    """languages by falling frequency; weight[bucket, language]; allowed[script, language]."""

    languages: list[str]
    weight: np.ndarray
    allowed: np.ndarray


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _segments(text: str):
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > SEGMENT_CHARS:
            cut = _NO_LETTER.search(text, at + SEGMENT_CHARS)
            stop = cut.end() if cut else stop
        yield at, text[at:stop]
        at = stop


def _trigrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of letters and the bucket of the trigram around each; a word's ends count as 0."""
    letter = _is_letter()[codes]
    held = np.where(letter, codes, 0).astype(np.uint64)
    padded = np.concatenate((np.zeros(1, np.uint64), held, np.zeros(1, np.uint64)))
    at = np.flatnonzero(letter)
    key = padded[at] * np.uint64(0x9E3779B97F4A7C15) ^ padded[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ padded[at + 2] * np.uint64(0x165667B19E3779F9)
    key = key * np.uint64(0xD6E8FEB86659FD93)
    return at, (key >> np.uint64(49)).astype(np.int64)


def _scripts(codes: np.ndarray) -> np.ndarray:
    return _SCRIPT_OF[np.searchsorted(_STARTS, codes, "right") - 1]


def train(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> Model:
    """A model from rows with a language and an id; about ``max_train`` of them, if there are more."""
    rows = documents.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where("lang IS NOT NULL AND doc_id IS NOT NULL")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r["lang"] for r in sizes]
    everything, least = sum(r["count"] for r in sizes), max_train / (RARE * max(1, len(sizes)))
    bars = [math.ceil(min(1.0, max(max_train * r["count"] / everything, least) / r["count"]) * HASHES) for r in sizes]
    bar = F.element_at(F.create_map(*[F.lit(x) for pair in zip(languages, bars, strict=True) for x in pair]), F.col("lang")) if sizes else F.lit(0)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)) < bar)
    place = {x: i for i, x in enumerate(languages)}

    def count(batches):
        grams = np.zeros((len(languages), BUCKETS), np.int64)
        scripts = np.zeros((len(languages), len(_NAMES)), np.int64)
        for batch in batches:
            for part in slices(batch):
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for _, piece in _segments(text or ""):
                        codes = _codes(piece)
                        at, bucket = _trigrams(codes)
                        grams[place[lang]] += np.bincount(bucket, minlength=BUCKETS)
                        scripts[place[lang]] += np.bincount(_scripts(codes[at]), minlength=len(_NAMES))
        both = np.concatenate((grams, scripts), axis=1)
        lang, slot = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(slot), pa.array(both[lang, slot])], names=["lang", "slot", "n"])

    found = (
        sample.select("text", "lang").mapInArrow(count, "lang long, slot long, n long")
        .groupBy("lang", "slot").agg(F.sum("n").alias("n"))
        .toArrow()  # languages x buckets rows at most
    )
    counts = np.zeros((len(languages), BUCKETS + len(_NAMES)))
    counts[found.column("lang").to_numpy(), found.column("slot").to_numpy()] = found.column("n").to_numpy()
    grams, scripts = counts[:, :BUCKETS] + 0.5, counts[:, BUCKETS:]
    weight = np.log(grams / grams.sum(axis=1, keepdims=True)) if languages else np.zeros((0, BUCKETS))
    weight = weight - (weight.max(axis=0, keepdims=True) if languages else 0)
    allowed = scripts >= 0.01 * np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return Model(languages, np.maximum(weight, -8.0).T.astype(np.float32).copy(), allowed.T.copy())


def word_scores(text: str, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length in letters and score per language of each word of one text."""
    starts, sizes, scores = [], [], []
    for offset, piece in _segments(text):
        if len(piece.lower()) != len(piece):  # rare letters that grow: keep positions
            piece = "".join(c if len(c.lower()) != 1 else c.lower() for c in piece)
            codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        else:
            codes = _codes(piece)
        at, bucket = _trigrams(codes)
        if not len(at):
            continue
        first = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
        step = max(1, BLOCK_FLOATS // (8 * max(1, len(model.languages))))  # words at a time
        ends = np.append(first[1:], len(bucket))
        own = np.concatenate([np.add.reduceat(model.weight[bucket[first[i] : ends[min(len(first), i + step) - 1]]], first[i : i + step] - first[i], axis=0) for i in range(0, len(first), step)])
        fits = model.allowed[_scripts(codes[at[first]])]
        own = np.where(fits, own, np.where(fits.any(axis=1, keepdims=True), np.float32(-60), np.float32(0)))
        starts.append(at[first] + offset)
        sizes.append(np.diff(np.append(first, len(at))))
        scores.append(own.astype(np.float32))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(model.languages)), np.float32)
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(scores)


def viterbi(
    scores: list[np.ndarray], switch: float = SWITCH, starts: list[np.ndarray] | None = None, ends: list[int] | None = None
) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Best label of each word of each text: sum of scores less ``switch`` for each change of label.

    ``starts``: scores of the languages before the first word; ``ends``: labels of the last word.  Also returned:
    the best score for each language of the last word, and the language before the first one.
    """
    lengths = np.array([len(s) for s in scores])
    if not lengths.sum():
        return [np.zeros(0, np.int64) for _ in scores], np.zeros((len(scores), 0), np.float32), np.zeros(len(scores), np.int64)
    n_lang = scores[0].shape[1]
    chunks = -(-lengths // CHUNK)
    first = np.concatenate(([0], np.cumsum(chunks)))
    padded = np.zeros((first[-1], CHUNK, n_lang), np.float32)
    flat = padded.reshape(-1, n_lang)
    for i, s in enumerate(scores):
        flat[first[i] * CHUNK : first[i] * CHUNK + len(s)] = s
    total = np.zeros((len(scores), n_lang), np.float32) if starts is None else np.array(starts, np.float32)
    # 1. best score from each language before the chunk to each one after it
    best = np.full((first[-1], n_lang, n_lang), _FAR, np.float32)
    best[:, np.arange(n_lang), np.arange(n_lang)] = 0
    for t in range(CHUNK):
        best = np.maximum(best, best.max(axis=2, keepdims=True) - np.float32(switch)) + padded[:, None, t]
    # 2. chain the chunks of each text, all texts at once
    entry = np.zeros(first[-1], np.int64)
    came = np.zeros((first[-1], n_lang), np.int64)
    for k in range(int(chunks.max())):
        live = np.flatnonzero(chunks > k)
        step = total[live][:, :, None] + best[first[live] + k]
        came[first[live] + k] = step.argmax(axis=1)
        total[live] = step.max(axis=1)
    state = total.argmax(axis=1) if ends is None else np.array(ends, np.int64)
    leave = np.zeros(first[-1], np.int64)
    for k in range(int(chunks.max()) - 1, -1, -1):
        live = np.flatnonzero(chunks > k)
        at = first[live] + k
        leave[at] = state[live]
        state[live] = came[at, state[live]]
        entry[at] = state[live]
    # 3. inside the chunks, from the known first language
    rows = np.arange(first[-1])
    value = np.full((first[-1], n_lang), _FAR, np.float32)
    value[rows, entry] = 0
    back = np.zeros((CHUNK, first[-1], n_lang), np.uint8 if n_lang <= 256 else np.int64)
    own = np.arange(n_lang)[None, :]
    for t in range(CHUNK):
        top = value.argmax(axis=1)
        jump = value[rows, top][:, None] - np.float32(switch)
        back[t] = np.where(jump > value, top[:, None], own)
        value = np.maximum(value, jump) + padded[:, t]
    labels = np.zeros((first[-1], CHUNK), np.int64)
    now = leave
    for t in range(CHUNK - 1, -1, -1):
        labels[:, t] = now
        now = back[t][rows, now].astype(np.int64)
    flat_labels = labels.reshape(-1)
    return [flat_labels[first[i] * CHUNK : first[i] * CHUNK + n] for i, n in enumerate(lengths.tolist())], total, state


def _block_words(languages: int) -> int:
    """Words whose tables of words x languages, and chunks x languages x languages, stay bounded."""
    return max(CHUNK, BLOCK_FLOATS // (languages * max(1, -(-languages // CHUNK))))


def _long_labels(scores: np.ndarray, switch: float, block: int, start: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """``viterbi`` of one text in blocks of words: forwards for the scores at the cuts, then backwards for the labels."""
    cuts = list(range(0, len(scores), block))
    before = [start]
    for at in cuts:
        before.append(viterbi([scores[at : at + block]], switch, [before[-1]])[1][0])
    state = int(before[-1].argmax()) if end is None else end
    labels = []
    for at, first in zip(cuts[::-1], before[-2::-1], strict=True):
        got, _, entry = viterbi([scores[at : at + block]], switch, [first], [state])
        labels.append(got[0])
        state = int(entry[0])
    return np.concatenate(labels[::-1]), before[-1], state


def _whole_text(text: str, model: Model, switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and labels of a text of many segments; scores are made twice and held for one segment."""
    block = _block_words(len(model.languages))
    parts, before = [], [np.zeros(len(model.languages), np.float32)]
    for offset, piece in _segments(text):
        starts, sizes, scores = word_scores(piece, model)
        if not len(scores):
            continue
        parts.append((piece, starts + offset, sizes))
        for at in range(0, len(scores), block):
            last = viterbi([scores[at : at + block]], switch, [last if at else before[-1]])[1][0]
        before.append(last)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    state, labels = int(before[-1].argmax()), []
    for (piece, _, _), first in zip(parts[::-1], before[-2::-1], strict=True):
        got, _, state = _long_labels(word_scores(piece, model)[2], switch, block, first, state)
        labels.append(got)
    return np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), np.concatenate(labels[::-1])


def _labelled(texts: list, model: Model, switch: float):
    if not model.languages:
        words = [word_scores(t or "", model) for t in texts]
        return [(s, n, np.zeros(0, np.int64)) for s, n, _ in words]
    block = _block_words(len(model.languages))
    out: list = [None] * len(texts)
    waiting: list[tuple[int, tuple]] = []

    def flush() -> None:
        for (i, w), labels in zip(waiting, viterbi([w[2] for _, w in waiting], switch)[0], strict=True):
            out[i] = (w[0], w[1], labels)
        waiting.clear()

    held = 0
    for i, text in enumerate(texts):
        if text and len(text) > SEGMENT_CHARS:
            out[i] = _whole_text(text, model, switch)
            continue
        w = word_scores(text or "", model)
        if len(w[2]) > block:
            out[i] = (w[0], w[1], _long_labels(w[2], switch, block, np.zeros(len(model.languages), np.float32), None)[0])
            continue
        waiting.append((i, w))
        held += len(w[2]) + CHUNK
        if held > block:
            flush()
            held = 0
    if waiting:
        flush()
    return out


def document_language(sizes: np.ndarray, labels: np.ndarray, model: Model) -> tuple[str, float]:
    """The language with the most letters and its share."""
    if not len(labels):
        return "und", 0.0
    letters = np.bincount(labels, sizes, minlength=len(model.languages))
    return model.languages[int(letters.argmax())], float(letters.max() / letters.sum())


def keep(documents: DataFrame, model: Model, *, text_col: str = "text", min_score: float = MIN_SCORE, switch: float = SWITCH) -> DataFrame:
    """The documents with a language that has at least ``min_score`` of their letters, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def sure(texts: list) -> list[bool]:
        found = [document_language(sizes, labels, shared.value) for _, sizes, labels in _labelled(texts, shared.value, switch)]
        return [lang != "und" and score >= min_score for lang, score in found]

    return filter_texts(documents, text_col, sure)


def predict(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and spans (start, end, lang; code points) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        preds, shares, spans = [], [], []
        for starts, sizes, labels in _labelled(batch.column(1).to_pylist(), m, switch):
            lang, score = document_language(sizes, labels, m)
            preds.append(lang)
            shares.append(score)
            if not len(labels):
                spans.append([])
                continue
            run_at = np.flatnonzero(np.concatenate(([True], np.diff(labels) != 0)))
            last = np.append(run_at[1:], len(labels)) - 1
            spans.append(
                [
                    {"start": int(starts[a]), "end": int(starts[b] + sizes[b]), "lang": m.languages[int(labels[a])]}
                    for a, b in zip(run_at, last, strict=True)
                ]
            )
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(preds, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, kind)],
            names=["doc_id", "lang_pred", "score", "spans"],
        )

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, run, "doc_id long, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")
