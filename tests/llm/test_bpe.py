"""BPE against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import pytest

from tidemark.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
VOCAB = public.path("word_bpe_49k.json")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def frame(spark, rows):
    """Rows (doc_id, text) with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, n_tokens int")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))



def test_bpe_equals_the_library(spark):
    t = tokenizers.Tokenizer.from_file(VOCAB)
    rng = random.Random(1)
    odd = ["<|endoftext|>a <|startoftext|>", "aaaa aaaaaaa hahahaha", "it's we'LL can't ½ ²3 12", "Σας ΟΔΟΣ İi", "é e\u0301 \u00a0\u2003x", "!!!???...", "\x1c\x85"]
    odd += ["".join(rng.choice("aeinrsth'o ") for _ in range(200)) for _ in range(50)]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x600), rng.randrange(0x4E00, 0x5000)])) for _ in range(80)) for _ in range(50)]
    rows = [(i, x) for i, x in enumerate(odd)] + [(1000, None), (None, "null id"), (1001, ""), (1002, prose(2, 20_000)), (1003, "z" * 3000)]
    got = bpe.round_trip_digests(frame(spark, rows), VOCAB).collect()
    for (doc, text), r in zip(rows, got, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (doc, len(ids)), text
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), text
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip_digests(frame(spark, rows).limit(0), VOCAB).count() == 0


def test_bpe_decode_inverts_encode(spark):
    docs = frame(spark, [(1, "hello world"), (2, None)])
    out = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, VOCAB), VOCAB).collect()}
    assert out == {1: "hello</w> world</w>", 2: ""}
    null = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(null, VOCAB).collect()} == {1: "", 2: ""}


def test_bpe_cuts_long_texts_at_any_white_space(monkeypatch):
    model = bpe.loaded(bpe._source(VOCAB))
    t = tokenizers.Tokenizer.from_file(VOCAB)
    text = "".join(prose(i, 7) + "\n\t\r\x0b"[i % 4] for i in range(40))
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    assert max(sum(map(len, p)) for p in model._pieces(text)) < 120
    assert model.encode_batch([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_are_refused():
    spec = json.loads(bpe._source(VOCAB))
    bpe.check_supported(spec)
    for change in ({"decoder": {"type": "ByteLevel"}}, {"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**spec["model"], "byte_fallback": True}}):
        with pytest.raises(ValueError, match="isn't carried out"):
            bpe.check_supported({**spec, **change})


def test_every_code_point_is_split_as_by_the_library():
    """Each one between letters, before a digit, doubled and after a combining mark."""
    model, t = bpe.loaded(bpe._source(VOCAB)), tokenizers.Tokenizer.from_file(VOCAB)
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = [f"b{c}b{c}.{c}{c}1{c}\u0301 {c}" for c in chars]
    for at in range(0, len(texts), 100_000):
        part = texts[at : at + 100_000]
        want = [x.ids for x in t.encode_batch_fast(part, add_special_tokens=False)]
        got = [x.tolist() for x in model.encode_batch(part)]
        assert got == want, next(x for x, a, b in zip(part, got, want, strict=True) if a != b)
    well_known = [c for c in chars if bpe.WELL_KNOWN.fullmatch(c)]
    plain = [f"b{c}b{c}.{c}{c}1{c} {c}" for c in well_known]
    assert len(well_known) > 20_000 and [model.encode_batch([x])[0].tolist() for x in plain] == [x.ids for x in t.encode_batch_fast(plain, add_special_tokens=False)]


def test_random_strings_of_any_characters_equal_the_library():
    model, t = bpe.loaded(bpe._source(VOCAB)), tokenizers.Tokenizer.from_file(VOCAB)
    rng = random.Random(12)
    pool = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(rng.choice([rng.choice(pool), rng.choice("abc1 ,'\u0301\u0327")]) for _ in range(rng.randrange(30))) for _ in range(20_000)]
    assert [x.tolist() for x in model.encode_batch(texts)] == [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)]
