"""Line dedup against a brute-force version, and its defined cases."""

import hashlib
import random
from collections import defaultdict

from tidemark.llm import line_dedup

WHITE = " \t\n\x0b\x0c\r"
A_Z = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
SCHEMA = "doc_id long, text string, h1 string, lines int"


def frame(spark, rows):
    """Rows (doc_id, text) with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(rows, min_chars=20, min_docs=3):
    where = defaultdict(set)
    key = lambda line: line.strip(WHITE).translate(A_Z)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                where[key(line)].add(-1 if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [len(docs := where.get(key(x), ())) >= min_docs and (-1 if doc is None else doc) != max(docs) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((-1 if doc is None else doc, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(df, **kw):
    rows = line_dedup.digests(df, line_dedup.keep_bitmaps(df, **kw)).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in rows)


def random_rows(seed, n):
    rng = random.Random(seed)
    shared = [f"{rng.choice(['A shared line', 'ÉCOLE partagée', 'ΣΊΣΥΦΟΣ and more'])} number {i:05d}" for i in range(30)]
    rows = []
    for doc in range(n):
        lines = []
        for _ in range(rng.randrange(12)):
            line = rng.choice([rng.choice(shared), f"only here {rng.random():.17f}", "short", "", "a very common licence line", " \t"])
            line = rng.choice([line, line.upper(), f"  {line}\r", f"\t{line}\x0b"])
            lines += [line] * rng.choice([1, 1, 1, 4])
        rows.append((doc * 7 % 1001, "\n".join(lines)))
    return rows


def test_line_dedup_equals_brute_force(spark):
    rows = random_rows(3, 400) + [(None, "a very common licence line\nx"), (None, "a very common licence line\nx"), (None, None), (5000, ""), (5001, None)]
    rows += [(6000, "A VERY common licence line\nfirst text"), (6000, "a very common licence line\nsecond text\na very common licence line")]
    rows += [(7000, "\n".join(f"a long text has line {i % 700:06d}" for i in range(20_000)))]
    rows += [(7001 + i, f"a long text has line {i:06d}\nkKelvin sign line of text {i % 2}\nKKELVIN sign line of text {i % 2}") for i in range(20)]
    random.Random(1).shuffle(rows)
    df = frame(spark, rows)
    assert found(df) == brute(rows)
    assert found(df, min_chars=4, min_docs=2) == brute(rows, 4, 2)


def test_a_line_of_every_document_is_dealt_to_several_ranges(spark):
    rows = [(i, f"the same opening line in all documents\nline of its own {i:010d}" + "\nthe same opening line in all documents" * (i % 3)) for i in range(9000)]
    df = frame(spark, rows).repartition(4)
    hot = line_dedup._frequent(line_dedup._hashed_lines(df, "doc_id", "text", 20), 4).collect()
    assert len(hot) == 1 and hot[0].salts >= 4
    assert found(df) == brute(rows)
    plan = line_dedup.keep_bitmaps(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_bitmaps_are_runs_of_kept_lines(spark):
    line = "a repeated line of enough characters"
    rows = [(1, f"a\n{line}\n{line}\nb\nc"), (2, line), (3, f"x\n{line}")]
    got = {r.doc_id: r for r in line_dedup.keep_bitmaps(frame(spark, rows)).collect()}
    assert [tuple(x) for x in got[1].keep] == [(0, 1), (3, 2)] and (got[1].n_lines, got[1].n_dropped) == (5, 2)
    assert got[2].keep == [] and 3 not in got


def test_empty_table(spark):
    assert found(frame(spark, []).limit(0)) == []
