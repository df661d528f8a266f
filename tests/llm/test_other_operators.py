"""URL rules, WARC archives, nearest neighbours, components."""

import base64
import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, urlfilter, warc
from tidemark.operators.components import connected_components
from tidemark.llm.queries import URL_RULES


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), a, h + p) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(2)
    hosts = ["example.org", "a.Example.ORG", "notexample.org", "x.com", "com", "org", "a.b.c.d.e.f.com", "É.org", "org.", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/123?q=1", "/fr/x#y", "/de/a/b", "?/de/", "/de//?x://y.org/es/", "/" + "z" * 5000]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme org/", "://", "a://b://c.org/es/"]
    rows = [(i, u, "x", "y", "z") for i, u in enumerate(urls)] + [(3, urls[3], "x", "y", "z"), (None, urls[1], "x", "y", "z")]
    rng.shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, digest string")
    got = urlfilter.judge(pages, urlfilter.rules_table(spark, URL_RULES)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(key((r[0], *brute_rule(r[1]))) for r in rows)
    assert urlfilter.judge(pages.limit(0), urlfilter.rules_table(spark, URL_RULES)).count() == 0
    none = urlfilter.judge(pages, urlfilter.rules_table(spark, URL_RULES).limit(0), default="block").collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "block")} and len(none) == len(rows)


def warc_rows():
    rng = random.Random(3)
    big = "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(60_000))
    rows = [(i, f"http://h/{i}", big[: 50 * i] if i % 3 else "same page") for i in range(1, 60)]
    return [*rows, (60, None, None), (61, "http://x\r\ny", ""), (62, "u", big * 3), (2, "http://h/2", rows[1][2]), (None, "n", "null id page"), (None, "n", "null id page"), (None, "n", "same page"), (None, "n", rows[0][2]), (None, None, None)]


def test_warc_round_trip(spark, tmp_path):
    rows = warc_rows()
    pages = spark.createDataFrame([(*r, "a", 1) for r in rows], "page_id long, url string, html string, piece string, block int")
    want = []
    payloads = [(r[0], (r[2] or "").encode()) for r in rows]
    for page, data in payloads:
        low = min((p for p, d in payloads if d == data and p is not None), default=None)
        first = low if low is not None and (page is None or page > low) else None
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first is None else "revisit", first))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # ranges far smaller than some records
    try:
        got = [tuple(r) for r in warc.round_trip(pages, path=f"{tmp_path}/w").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0
    small = warc.round_trip(pages, min_payload=10**9).collect()
    assert {r.record_type for r in small} == {"response"} and len(small) == len(rows)


def test_warc_round_trip_keeps_payloads_in_the_archives_only(spark, tmp_path):
    rng = random.Random(3)
    pages = spark.createDataFrame([(i, "u", "%0100000x" % rng.getrandbits(400_000)) for i in range(20)], "page_id long, url string, html string")
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before = set(shared.glob("*/warc-records-*"))
    assert warc.round_trip(pages, path=f"{tmp_path}/w").agg(F.sum("payload_bytes")).first()[0] == 2_000_000
    (new,) = set(shared.glob("*/warc-records-*")) - before
    assert sum(f.stat().st_size for f in new.iterdir()) < 300_000
    assert {len(r.payload) for r in warc.read_archives(spark, f"{tmp_path}/w").collect()} == {100_000}


def test_warc_false_magic_inside_a_member(spark, tmp_path):
    """Stored (uncompressed) members that hold the magic bytes, and the WARC header text, across ranges."""
    def member(data):
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        return packer.compress(data) + packer.flush()

    trap = (warc.MAGIC + b"\x00" * 30 + b"filler ") * 200
    body = "".join(chr(b) if b < 128 else "?" for b in trap).encode()
    data = b"".join(member(warc._record(i, "u", body if i % 2 else trap, None)) for i in range(1, 8))
    path = tmp_path / "a"
    path.mkdir()
    (path / "x.warc").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted(r.page_id for r in warc.read_archives(spark, str(path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == list(range(1, 8))


def test_warc_archives_named_gz_and_foreign_records(spark, tmp_path):
    path = tmp_path / "gz"
    path.mkdir()
    other = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n"
    foreign = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:5>\r\nContent-Length: 21\r\n\r\nHTTP/1.0 200 OK\r\n\r\nab\r\n\r\n"
    for n in (1, 2):
        records = [other, *[warc._record(10 * n + i, "u", b"page %d" % i, None) for i in range(5)], foreign]
        (path / f"a{n}.warc.gz").write_bytes(b"".join(map(warc._member, records)))
    got = warc.read_archives(spark, str(path)).collect()
    assert sorted(r.page_id for r in got if r.page_id) == [*range(10, 15), *range(20, 25)]
    assert [(r.record_id, r.payload, r.payload_bytes, r.payload_digest) for r in got if not r.page_id] == [("<urn:uuid:5>", bytearray(b"ab"), 2, None)] * 2


def test_warc_magic_in_the_first_bytes_of_a_member(spark, tmp_path):
    """A member whose header's extra field holds the magic is found after the one before it."""
    def member(data):
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
        extra = b"AB\x03\x00" + warc.MAGIC
        return warc.MAGIC + b"\x04" + bytes(6) + len(extra).to_bytes(2, "little") + extra + body + zlib.crc32(data).to_bytes(4, "little") + len(data).to_bytes(4, "little")

    path = tmp_path / "m"
    path.mkdir()
    kinds = [warc._member, member, member, warc._member, member]
    (path / "x.warc").write_bytes(b"".join(k(warc._record(i, "u", b"body %d" % i, None)) for i, k in enumerate(kinds)))
    assert sorted(r.page_id for r in warc.read_archives(spark, str(path)).collect()) == list(range(5))


def test_warc_broken_members_are_reported(spark, tmp_path):
    whole = [warc._member(warc._record(i, "u", b"body %d" % i, None)) for i in range(4)]
    for name, data in (("cut", whole[0] + whole[1][:-20] + whole[2]), ("end", whole[0] + whole[2] + whole[1][:-9]), ("plain", warc._record(1, "u", b"x", None) + whole[0] + whole[2])):
        path = tmp_path / name
        path.mkdir()
        (path / "x.warc").write_bytes(data)
        with pytest.raises(Exception, match="no complete gzip member"):
            warc.read_archives(spark, str(path)).collect()
        got = warc.read_archives(spark, str(path), on_broken="keep").collect()
        assert sorted(r.page_id for r in got if r.warc_type != "broken") == [0, 2] and sum(r.warc_type == "broken" for r in got) == 1, name


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((10, dim))
    return (centres[rng.integers(0, 10, n)] + 0.5 * rng.standard_normal((n, dim))).astype(np.float32)


def test_neighbours_recall_and_scores(spark):
    x = vectors(1500, 16, 1)
    x[700:1000] = x[700]  # a hot vector
    rows = [(i, v.tolist(), 1.0, 0) for i, v in enumerate(x)]
    bad = [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] + [1.0] * 15), (2300, [None] + [1.0] * 15), (2400, [1.0] * 3), (2500, [float("inf")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + [(*b, 1.0, 0) for b in bad], "vec_id long, embedding array<float>, score double, cell int")
    got = ann.search(df, F.col("vec_id") % 100 == 0, k=10).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1))
        d[q] = np.inf
        true = np.lexsort((np.arange(1500), d))[:10]
        assert all(abs(d[v] - s) < 1e-9 for v, s in by[q]) and [s for _, s in by[q]] == sorted(s for _, s in by[q])
        hits += len(set(true.tolist()) & {v for v, _ in by[q]})
    assert set(by) == set(range(0, 1500, 100)) and hits >= 0.9 * 150
    assert [v for v, _ in by[700]] == list(range(701, 711))


def test_neighbours_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 1)]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
