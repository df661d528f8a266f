"""Many moves of a Markov chain, and passages with a common opening."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import grid, text


def test_a_thousand_moves_equal_matrix_powers(spark):
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 6, (7, 7))
    counts[6] = 0  # never left
    counts[:6, 6] = [0, 0, 1, 0, 0, 0]
    moves = spark.createDataFrame([("a", i, j, int(counts[i, j])) for i in range(7) for j in range(7) if counts[i, j]], "k string, `from` long, to long, n long")
    start = spark.createDataFrame([("a", 0)], "k string, cell long")
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    p[6, 6] = 1.0
    for n in (9, 1000):
        got = {r.cell: r.mass for r in grid.n_step(moves, ["k"], start, n).collect()}
        want = np.linalg.matrix_power(p, n)[0]
        assert [got.get(i, 0.0) for i in range(7)] == pytest.approx(want.tolist(), abs=1e-9)


def test_a_common_opening_brings_nobody_together(spark):
    opening = "all documents begin with these words, "
    docs = spark.createDataFrame([(i, f"{opening}document {i} says {i * 7919} and more") for i in range(300)] + [(900, None), (901, "")], "doc_id long, text string")
    patterns = spark.createDataFrame([(f"{opening}document {i} says {i * 7919}",) for i in range(0, 300, 50)] + [(f"{opening}nothing like it",), ("says 0",)], "pattern string")
    rows = docs.where(F.col("text").isNotNull())
    assert text._with_rare_gram(rows, patterns.where(F.length("pattern") >= 8), "doc_id", "text", 8).count() <= 12
    got = {(r.doc_id, r.pattern) for r in text.pattern_hits(docs, patterns, "doc_id").collect()}
    all_ = [r.pattern for r in patterns.collect()]
    assert got == {(r.doc_id, p) for r in rows.collect() for p in all_ if p in r.text} and len(got) == 7


def test_passages_of_words_meet_texts_by_words(spark, monkeypatch):
    """Words and spaces in all positions, cut words at the ends, several spaces; texts are not taken apart into runs of characters."""
    grams = text._grams
    monkeypatch.setattr(text, "_grams", lambda column, n: grams(column, n) if column == "pattern" else pytest.fail("characters"))
    texts = ["one two three four five six", "xone two three four fivex six", "one  two three  four five", " one two three four five ", "", "two three four", None, "one two three four\nfive six", "é two three four five é"]
    patterns = ["one two three four five", "ne two three four fiv", "one  two three  four", " two three four ", "two three four five six seven", "  two three  four ", "two three four\nfive six x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.pattern) for r in text.pattern_hits(docs, spark.createDataFrame([(p,) for p in patterns], "pattern string"), "doc_id").collect()}
    assert got == {(i, p) for i, t in enumerate(texts) for p in patterns if t and p in t} and len(got) > 8
