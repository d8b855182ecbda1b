"""Content-addressed web archive.

Payload bytes are stored once per strong digest (SHA-256, verified when written and when read); exact WARC record
headers are kept in a table of their own; original records come back through joins, in which adaptive execution splits
the records of a frequent payload. Of records with equal payloads of at least ``min_bytes`` the one with the largest
page_id is a ``response``, the others are ``revisit`` records.

Null html is an empty payload; a null url leaves WARC-Target-URI out. Rows with a null page_id are archived under
the id ``null`` and never chosen as response unless all their copies are null. Repeated rows of the response's
page_id are responses too. Empty tables give empty archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import setup, shared_dir, text_buffer

CRLF = b"\r\n"


def b32sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _digests(batches):
    for b in batches:
        raw, off = text_buffer(b.column("html"))
        raw, off = raw.tobytes(), off.tolist()
        parts = [raw[i:j] for i, j in zip(off, off[1:])]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array([hashlib.sha256(p).digest() for p in parts], pa.binary()), pa.array([b32sha1(p) for p in parts], pa.string()), pa.array([len(p) for p in parts], pa.int64())],
            ["page_id", "url", "address", "sha1", "n"],
        )


def _payloads(batches):
    """Each payload once per task, compressed, with its address."""
    seen, pack = set(), zstandard.ZstdCompressor(level=3)
    for b in batches:
        raw, off = text_buffer(b.column("html"))
        raw, off = raw.tobytes(), off.tolist()
        keys, data = [], []
        for i, j in zip(off, off[1:]):
            p = raw[i:j]
            a = hashlib.sha256(p).digest()
            if a not in seen:
                seen.add(a)
                keys.append(a)
                data.append(pack.compress(p))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["address", "payload"])


def _headers(date: str):
    def build(batches):
        for b in batches:
            out = []
            for page, url, sha1, n, kind, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "sha1", "n", "record_type", "refers_to"))):
                lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), f"WARC-Record-ID: <urn:x-page:{'null' if page is None else page}>".encode(), f"WARC-Date: {date}".encode()]
                if url is not None:
                    lines.append(b"WARC-Target-URI: " + url.encode("utf-8", "replace").replace(b"\r", b"%0D").replace(b"\n", b"%0A"))
                lines.append(f"WARC-Payload-Digest: sha1:{sha1}".encode())
                if kind == "revisit":
                    lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers}>".encode()]
                lines += [b"Content-Type: text/html; charset=utf-8", f"Content-Length: {n if kind == 'response' else 0}".encode()]
                out.append(CRLF.join(lines) + CRLF + CRLF)
            yield pa.RecordBatch.from_arrays([b.column("address"), pa.array(out, pa.binary())], ["address", "header"])

    return build


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes ``path/payloads`` (address, payload) and ``path/headers`` (address, header) as Parquet."""
    setup(pages.sparkSession)
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    src.select("html").mapInArrow(_payloads, "address binary, payload binary").groupBy("address").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    rows = src.mapInArrow(_digests, "page_id long, url string, address binary, sha1 string, n long")
    kept = rows.groupBy("address").agg(F.max("page_id").alias("keep"))
    alone = (F.col("n") < min_bytes) | F.col("keep").isNull() | F.coalesce(F.col("page_id") == F.col("keep"), F.lit(False))
    rows.join(kept, "address").select(
        "page_id", "url", "address", "sha1", "n", F.when(alone, "response").otherwise("revisit").alias("record_type"), F.when(~alone, F.col("keep")).alias("refers_to")
    ).mapInArrow(_headers(date), "address binary, header binary").write.parquet(f"{path}/headers")


def fields(header: bytes) -> dict[str, str]:
    """The named fields of a record header."""
    lines = header.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}


def _ids(urn: str | None):
    x = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return None if x in ("", "null") else int(x)


def _rebuilt(batches):
    """The record bytes of each header and payload; the payload must match its address."""
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        records, bodies, known = [], [], (None, b"")
        for a, h, p in zip(*(b.column(c).to_pylist() for c in ("address", "header", "payload"))):
            if a != known[0]:  # records of one payload mostly follow each other
                known = a, unpack(p)
                if hashlib.sha256(known[1]).digest() != a:
                    raise ValueError(f"payload {a.hex()} does not match its address")
            records.append(h + (known[1] if fields(h)["warc-type"] == "response" else b"") + CRLF + CRLF)
            bodies.append(known[1])
        ids = [_ids(fields(h)["warc-record-id"]) for h in b.column("header").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(records, pa.binary()), pa.array(bodies, pa.binary())], ["page_id", "record", "payload"])


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """address, header, payload of every record."""
    setup(spark)
    return spark.read.parquet(f"{path}/headers").join(spark.read.parquet(f"{path}/payloads"), "address").select("address", "header", "payload")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record (the exact WARC record bytes) and payload (whole, also of revisits)."""
    return _whole(spark, path).mapInArrow(_rebuilt, "page_id long, record binary, payload binary")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a WARC record; its Content-Length must be that of the block."""
    header, _, rest = record.partition(CRLF + CRLF)
    named = fields(header)
    block = rest[: -2 * len(CRLF)]
    if int(named["content-length"]) != len(block) or not rest.endswith(CRLF + CRLF):
        raise ValueError(f"record {named['warc-record-id']} has {len(block)} bytes, not {named['content-length']}")
    return named, block


def _read(batches):
    for b in _rebuilt(batches):
        cols = [[], [], [], [], []]
        for record, payload in zip(b.column("record").to_pylist(), b.column("payload").to_pylist()):
            named, block = parse(record)
            said, kind = named["warc-payload-digest"].removeprefix("sha1:"), named["warc-type"]
            if b32sha1(payload) != said or (kind == "response" and block != payload):
                raise ValueError(f"record {named['warc-record-id']} does not hold the payload it names")
            for c, v in zip(cols, (_ids(named["warc-record-id"]), len(payload), said, kind, _ids(named.get("warc-refers-to")))):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read from the rebuilt record
    bytes; addresses, payload digests and lengths are verified."""
    return _whole(spark, path).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, sha256(h) AS a FROM p),
k AS (SELECT a, max(page_id) AS keep FROM d GROUP BY a)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, ((i // 8) * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM d JOIN k USING (a)
"""


def op9_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path)
