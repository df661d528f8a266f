"""Tokenizer alignment against a brute-force version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import align

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, page string, n_a int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(rows):
    """All from the libraries' own tokens, pair by pair."""
    t = tokenizers.Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = align._byte_of_letter()
    ordinary = {i: bytes(letters[c] for c in s) for s, i in t.get_vocab().items() if s != "<|endoftext|>"}
    docs, counts = [], Counter()
    for doc, text in rows:
        want = (" " + (text or "")).encode()
        a = [(i, ordinary[i]) for i in t.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)] if text else []
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            a = b = []
        spans = [[(i, sum(len(x) for _, x in ts[:k]), sum(len(x) for _, x in ts[: k + 1])) for k, (i, _) in enumerate(ts)] for ts in (a, b)]
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = [[[i for i, s, e in side if lo <= s and e <= hi] for side in spans] for lo, hi in zip([0, *cuts], cuts, strict=False)]
        links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
        counts.update(links)
        docs.append((doc, len(a), len(b), groups, links))
    best = {}
    for (i, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for doc, na, nb, groups, links in docs:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((doc, na, nb, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if na else ""))
    return sorted(out, key=repr), [(d, g) for d, _, _, g, _ in docs]


WORDS = "The quick brown fox can't jump over 1234 lazy dogs naïve Straße 東京タワー Привет мир x+=1; return  <0x41> <|endoftext|> </s> ▁ \n\n \t 😀 ﬁn   zzzzqqqq".split(" ")


def random_rows(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30)))) for i in range(n)]


def rows_of(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [align.BLOCK_PAIRS, 50])
def test_digests_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK_PAIRS", block)
    rows = random_rows(4, 150) + [(None, "a null id"), (900, None), (901, ""), (902, " "), (903, "same"), (903, "same"), (904, "q" * 500), (905, "\x00\x7f")]
    assert rows_of(align.alignment_digests(frame(spark, rows).repartition(3), A, B)) == brute(rows)[0]


def test_groups_and_empty_table(spark):
    rows = random_rows(6, 20) + [(100, None)]
    got = {r.doc_id: [[list(g.a), list(g.b)] for g in r.groups] for r in align.align(frame(spark, rows), A, B).collect()}
    assert got == dict(brute(rows)[1])
    assert align.alignment_digests(frame(spark, rows).limit(0), A, B).count() == 0


def test_common_ends_of_random_cuts():
    rng = random.Random(8)
    for n in (1, 5, 40, 3000):
        for share in (0.1, 0.5, 0.99):
            both = {i for i in range(1, n) if rng.random() < share}
            a = np.array(sorted({i for i in both if rng.random() < 0.97} | {i for i in range(1, n) if rng.random() < 0.05} | {n}))
            b = np.array(sorted({i for i in both if rng.random() < 0.97} | {n}))
            in_a, in_b = align.common_ends(a, b)
            common = np.intersect1d(a, b)
            assert a[in_a].tolist() == b[in_b].tolist() == common.tolist()


def test_faster_encoder_equals_the_library_on_all_well_known_letters():
    pair = align.loaded(*align._sources(A, B))
    assert pair.fast is not None
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and align.WELL_KNOWN.fullmatch(chr(i))]
    texts = [f"b{c}b{c}.{c} {c}{c}1{c}" for c in chars] + [t for _, t in random_rows(9, 200) if align.WELL_KNOWN.fullmatch(t)]
    want = [x.ids for x in pair.a.encode_batch(texts, add_special_tokens=False)]
    assert len(chars) > 20_000 and [pair.fast.encode_ordinary(t) for t in texts] == want


def test_token_counts(spark):
    rows = random_rows(11, 40) + [(100, None), (101, "")]
    t = tokenizers.Tokenizer.from_file(A)
    t.encode_special_tokens = True
    got = {r.doc_id: (r.n_tokens, r.page) for r in align.with_token_counts(frame(spark, rows), A).collect()}
    assert got == {d: (len(t.encode(x or "", add_special_tokens=False).ids), "x") for d, x in rows}
