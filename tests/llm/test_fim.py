"""Fill-in-middle: cuts by brute force, exact round trip, defined cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import fim

SCHEMA = "doc_id long, text string, form string, h1 int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(doc, text):
    text, x = text or "", hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    n = len(text)
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in fim.Sentinels()) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def random_text(rng, n):
    return "".join(rng.choice(["a", "é", " ", "\n", "漢", "😀", "b.", "é"]) for _ in range(n))


def test_transform_equals_brute_force_and_restores(spark):
    rng = random.Random(5)
    rows = [(i, random_text(rng, rng.randrange(60))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "has <S> inside"), (1003, "<P"), (None, "no id but text"), (1004, random_text(rng, 300_000)), (1, "again"), (1, "again")]
    rng.shuffle(rows)
    made = fim.transform(frame(spark, rows))
    key = lambda x: (x[0] is None, x[0] or 0, x[-1])
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in made.collect()), key=key)
    assert got == sorted(((d, *brute(d, t)) for d, t in rows), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = made.select("doc_id", fim.restored().alias("text")).collect()
    assert sorted((repr(r.doc_id), r.text) for r in back) == sorted((repr(d), t or "") for d, t in rows)
    assert all(r.restored_sha256 in {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows} for r in fim.digests(made).collect())
    assert fim.digests(fim.transform(frame(spark, rows).limit(0))).count() == 0


def test_ranks_of_the_wavelet_matrix():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 1000):
        x = rng.integers(0, 8, n).astype(np.uint8)
        w = fim.WaveletMatrix(x, 3)
        for i in {0, n // 2, n}:
            assert [w.rank(c, i) for c in range(8)] == [int((x[:i] == c).sum()) for c in range(8)]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_cuts_of_each_unit(unit):
    rng = random.Random(unit)
    split = {"char": r"(?s).", "line": r"[^\n]*\n|[^\n]+\Z"}.get(unit)
    for _ in range(60):
        text = random_text(rng, rng.randrange(80)).lstrip()
        cutter = fim.Cutter(text.encode(), unit)
        if unit == "word":  # a word starts after white space; every line is a unit too
            starts = [i for i in range(len(text)) if i == 0 or text[i - 1] == "\n" or (text[i - 1] in " \n" and text[i] not in " \n")]
            pieces = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=False)]
        else:
            pieces = re.findall(split, text)
        assert "".join(pieces) == text and cutter.units == len(pieces)
        assert [cutter.cut(k) for k in range(len(pieces) + 1)] == [len("".join(pieces[:k]).encode()) for k in range(len(pieces) + 1)]


def test_unknown_units_are_refused(spark):
    with pytest.raises(ValueError, match="unit"):
        fim.transform(frame(spark, []), unit="page")
