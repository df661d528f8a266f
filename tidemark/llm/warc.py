"""WARC archives: a writer that goes through Spark's sink, and a splittable reader.

Writing.  Payload digests are grouped first (pre-aggregated), so each record knows whether
it is the response or a revisit.  Tasks build one gzip member per record and hand Spark's
text sink blocks of members; the block separator is the zero byte with which a block ends
anyway (a block whose last byte is not zero gets an empty member).  Files
therefore are plain concatenated gzip members on any file system Spark can write,
committed by Spark's protocol.

Reading.  Spark's text source splits files into byte ranges and cuts them at the gzip
magic; a range owns the candidates that start inside.  Candidates are validated by
inflating their start and looking for a WARC header; pieces that belong to the member
before (the magic occurred inside compressed data) are joined to it again.  A member
that does not end within its range is completed from the next ranges' leading pieces,
grouped by file; those rows are few.  What follows a member's end is parsed as the next one, so a member
whose own start was not taken for one (the magic within its first bytes cuts it too short) is found there.
Files named ``*.gz`` are read raw too (Hadoop's pass-through codec keeps Spark from inflating
them), but one task a file: Spark splits no file that a codec claims.  Other names are split.

Defined cases: a null html is an empty payload; null ids and repeated rows are written
each, rows equal in id and payload share the record type; a page with a null id revisits any page with an id and the same payload (without one, it is a response); payloads shorter than
``min_payload`` are all responses; an empty table gives no record; other columns are ignored.
Bytes that form no complete record (damaged, truncated or uncompressed ones) raise an error that names
the file, or, with ``on_broken="keep"``, come back as rows of warc_type ``broken``.  Records of other
kinds than response and revisit are passed over; ids, sizes and digests that a foreign record lacks or writes otherwise are null.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.sources.scratch import materialize, scratch_path

MAGIC = b"\x1f\x8b\x08"
BLOCK_BYTES = 1 << 20
BROKEN = -1
DATE = "2024-01-01T00:00:00Z"
RECORDS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "warc_type string, url string, record_id string, payload binary"
)
NAMES = [x.split()[0] for x in RECORDS.split(", ")]


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


_EMPTY = _member(b"")


def _record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One WARC record; ``first``: the page that a revisit refers to."""
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    uri = (url or "").encode("utf-8", "surrogatepass").replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>".encode(),
        b"WARC-Date: " + DATE.encode(),
        b"WARC-Target-URI: " + uri,
        f"WARC-Payload-Digest: sha1:{_sha1(payload)}".encode(),
        b"Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{first}>".encode(),
        ]
    lines.append(f"Content-Length: {len(body)}".encode())
    return b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n"


def plan_records(pages: DataFrame, *, id_col: str, url_col: str, html_col: str, min_payload: int) -> DataFrame:
    """page_id, url, payload, first: the smallest other page with the same payload, if any."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = (
        rows.where(F.octet_length("payload") >= min_payload)
        .groupBy("digest")
        .agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("copies"))
        .where("low IS NOT NULL AND copies > 1")
        .select("digest", "low")
    )
    joined = rows.join(firsts, "digest", "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("low")), F.col("low")).alias("first"))


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_payload: int = 0,
) -> None:
    """One record per row of ``pages``, as gzip members in the files of folder ``path``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(parts: list[bytes]) -> pa.RecordBatch:
            data = b"".join(parts)
            if data[-1]:
                data += _EMPTY
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["block"])

        parts, size = [], 0
        for batch in batches:
            for piece in slices(batch):
                for row in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    parts.append(_member(_record(*row)))
                    size += len(parts[-1])
                    if size >= BLOCK_BYTES:
                        yield block(parts)
                        parts, size = [], 0
        if parts:
            yield block(parts)

    plan = plan_records(pages, id_col=id_col, url_col=url_col, html_col=html_col, min_payload=min_payload)
    blocks = plan.mapInArrow(pack, "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


def _starts_record(data: bytes) -> bool:
    """Does a gzip member that begins like this hold a WARC header (or nothing)?"""
    if len(data) < 18 or data[3] & 0xE0:
        return False
    try:
        inflate = zlib.decompressobj(31)
        head = inflate.decompress(data[:4096], 16)
    except zlib.error:
        return False
    return head.startswith(b"WARC/1.") or (head == b"" and inflate.eof)


def _members(data: bytes) -> tuple[list[bytes], bytes]:
    """Contents of the gzip members that ``data`` holds one after the other, and the bytes that end none."""
    out = []
    while data.startswith(MAGIC):
        try:
            inflate = zlib.decompressobj(31)
            contents = inflate.decompress(data)
        except zlib.error:
            break
        if not inflate.eof:
            break
        out.append(contents)
        data = inflate.unused_data.lstrip(b"\x00")
    return out, data


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return {k.decode("latin-1").strip().lower(): v.decode("utf-8", "replace").strip() for k, v in pairs}


def parse_records(data: bytes) -> tuple[list[tuple], bytes]:
    """Rows of RECORDS of one member's contents, and what is no record."""
    rows = []
    while data:
        head, gap, rest = data.partition(b"\r\n\r\n")
        fields = _fields(head)
        size = fields.get("content-length", "")
        if not gap or not head.startswith(b"WARC/1.") or not size.isdigit() or len(rest) < int(size):
            return rows, data
        body, data = rest[: int(size)], rest[int(size) :].removeprefix(b"\r\n\r\n")
        if row := _row(fields, body):
            rows.append(row)
    return rows, b""


def _row(fields: dict[str, str], body: bytes) -> tuple | None:
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = body.partition(b"\r\n\r\n")
    kept = fields.get("warc-payload-digest", "")
    digest = kept.removeprefix("sha1:") if kept.startswith("sha1:") and len(kept) == 37 else None

    def page(name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", fields.get(name, ""))
        return int(found[1]) if found else None

    if kind == "response":
        size = len(payload)
        if digest and _sha1(payload) != digest:
            raise ValueError(f"payload digest of {fields.get('warc-record-id')} differs")
    else:
        length = _fields(http).get("content-length", "")
        size = int(length) if length.isdigit() else None
    return (page("warc-record-id"), size, digest, kind, page("warc-refers-to"), kind, fields.get("warc-target-uri", ""), fields.get("warc-record-id"), payload)


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """The columns ``names``, the first ones of RECORDS."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(cols[i], kinds[i]) for i in range(len(names))], names=names)


def read_archives(spark: SparkSession, path: str, *, on_broken: str = "raise", payloads: bool = True) -> DataFrame:
    """The response and revisit records of all archives in ``path``.

    Without ``payloads`` they are read and checked against their digests too, but neither written to the scratch folder nor returned.
    """
    records = RECORDS if payloads else RECORDS.removesuffix(", payload binary")
    names = NAMES if payloads else NAMES[:-1]
    if on_broken not in ("raise", "keep"):
        raise ValueError(f"on_broken: {on_broken!r}")
    pieces = (
        spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1")
        .option("io.compression.codecs", "org.apache.hadoop.io.compress.PassthroughCodec")
        .options(**{f"{at}io.compress.passthrough.extension": ".gz" for at in ("", "org.apache.hadoop.shaded.")})  # Spark's Hadoop client is shaded
        .text(path)
        .select(
            F.col("value").cast("binary").alias("piece"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        )
    )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Complete records, and fragments (file, block, place, bytes) of members that cross ranges."""
        at, open_, lead, place = None, b"", [], 0
        rows, size = [], 0
        frags: list[tuple] = []

        def close() -> None:
            nonlocal open_
            if open_:
                members, rest = _members(open_)
                for data in members:
                    found, bad = parse_records(data)
                    rows.extend(found)
                    if bad:
                        frags.append((*at, BROKEN, bad))
                if rest:
                    frags.append((*at, place - 1, rest))
            open_ = b""

        def flush() -> pa.RecordBatch:
            nonlocal rows, size, frags
            table, n, k = _table(rows, names), len(rows), len(frags)
            cols = [pa.concat_arrays([c, pa.nulls(k, c.type)]) for c in table.columns]
            for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary())):
                cols.append(pa.concat_arrays([pa.nulls(n, kind), pa.array([f[i] for f in frags], kind)]))
            rows, size, frags = [], 0, []
            return pa.RecordBatch.from_arrays(cols, names=[*table.schema.names, "file", "block", "place", "bytes"])

        for batch in batches:
            for piece, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != at:
                    close()
                    at, place = (file, block), 0
                    if block == 0:  # what stands before the first magic of a file
                        place = 1
                        if piece:
                            frags.append((*at, BROKEN, piece))
                        continue
                candidate = MAGIC + piece
                if _starts_record(candidate):
                    close()
                    open_ = candidate
                elif open_:
                    open_ += candidate
                else:
                    frags.append((*at, place, candidate))
                place += 1
                size += len(piece)
                if size >= BLOCK_BYTES:
                    yield flush()
        close()
        yield flush()

    schema = f"{records}, file string, block long, place long, bytes binary"
    found = materialize(pieces.mapInArrow(whole, schema), "warc-records")

    def complete(key: tuple, rows: pa.Table) -> pa.Table:
        """Members of one file that cross ranges: each head is followed by the next ranges' leading pieces."""
        rows = rows.sort_by([("block", "ascending"), ("place", "ascending")])
        out, bad, open_ = [], [], b""
        for place, data in [*zip(rows.column("place").to_pylist(), rows.column("bytes").to_pylist(), strict=True), (0, None)]:
            if place == BROKEN:
                bad.append(data)
                continue
            if open_ and (data is None or _starts_record(data)):
                members, rest = _members(open_)
                parsed = [parse_records(m) for m in members]
                out += [r for p in parsed for r in p[0]]
                bad += [x for x in [*(p[1] for p in parsed), rest] if x]
                open_ = b""
            if data is not None:
                if open_ or _starts_record(data):
                    open_ += data
                else:
                    bad.append(data)
        if bad and on_broken == "raise":
            raise ValueError(f"{sum(map(len, bad))} bytes of {key[0]} are no complete gzip member with WARC records")
        out += [(None, len(x), None, None, None, "broken", None, None, x) for x in bad]
        return pa.Table.from_batches([_table(out, names)])

    crossing = found.where("bytes IS NOT NULL").groupBy("file").applyInArrow(complete, records)
    return found.where("bytes IS NULL").select(*names).unionByName(crossing)


def round_trip(pages: DataFrame, *, min_payload: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages`` and read the archives back: one row per page."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_payload=min_payload)
    return read_archives(pages.sparkSession, path, payloads=False).drop("warc_type", "url", "record_id")
