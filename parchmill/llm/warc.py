"""WARC archives, index first.

Writing gives an index row for each record: file, offset, length, url and digest. Reading starts from the index:
the rows that are wanted are dealt out by stretches of a file, sorted by offset, and neighbouring byte ranges are
fetched together. Records are gzip members of their own, so any of them can be read alone. Files lie in the shared
scratch folder, reached through pyarrow's file systems; a task that runs again writes another file, and only files
that the settled index names are ever read.

Of records with equal payloads the one with the least id is the response and the others revisit it; repeated rows of
that least id are responses too. Payloads shorter than `least_bytes` are never revisits. Null payloads are empty, null
urls leave the target out, null ids are responses of their own. Columns other than id, url and payload are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.session import read_table, scratch_path, settled, shuffle_width

DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 256 << 20
#: One read takes ranges with gaps of at most GAP bytes, and READ_BYTES or a single record.
GAP, READ_BYTES = 64 << 10, 4 << 20
STRETCH = 4 << 20
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _one_line(x: str) -> str:
    return x.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str = DATE) -> bytes:
    """One record as a gzip member. first: the id that a revisit refers to, or none. A revisit keeps the HTTP head, which
    states the payload's length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_one_line(url)}"] if url is not None else []
    head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if first is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple:
    """(page_id, url, type, refers_to, payload bytes, digest, payload) of a record's gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    ident = lambda x: None if x is None or x == "<urn:page:None>" else int(x[len("<urn:page:") : -1])
    kind = fields["WARC-Type"]
    return (ident(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, ident(fields.get("WARC-Refers-To")), size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), payload.decode() if kind == "response" else None)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write every row as a record below `folder`; the settled index."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("html")).withColumn("_sha1", F.sha1(F.encode("html", "utf-8")))
    long_enough = rows.where(F.octet_length("html") >= least_bytes).where("page_id is not null")
    firsts = settled(long_enough.groupBy("_sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("_last")).where("first < _last").select("_sha1", "first"), "payloads")
    judged = rows.join(firsts, "_sha1", "left").select("page_id", "url", "html", F.expr(f"if(first < page_id and octet_length(html) >= {least_bytes}, first, null)").alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(folder)
        fs.create_dir(base, recursive=True)
        sink, name, at = None, "", 0
        try:
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    out: list[tuple] = []
                    for page_id, target, html, first in zip(*(c.to_pylist() for c in b.slice(k, 256).columns), strict=True):
                        if sink is None or at >= ROLL_BYTES:
                            if sink is not None:
                                sink.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                        data = html.encode()
                        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
                        member = record(page_id, target, data, digest, first)
                        sink.write(member)
                        out.append((name, at, len(member), page_id, target, digest, "response" if first is None else "revisit"))
                        at += len(member)
                    if out:
                        s, i = pa.string(), pa.int64()
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (s, i, i, i, s, s, s), strict=True)], names=["file", "offset", "length", "page_id", "url", "digest", "record_type"])
        finally:
            if sink is not None:
                sink.close()

    return settled(judged.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index rows name, read back from their files."""
    dealt = index.select("file", "offset", "length").withColumn("_stretch", F.expr(f"offset div {STRETCH}")).repartition(shuffle_width(index.sparkSession), "file", "_stretch").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(folder)
        opened, source = None, None
        for b in batches:
            wanted = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            k = 0
            while k < len(wanted):
                name, start, _ = wanted[k]
                last, end = k, start + wanted[k][2]
                while last + 1 < len(wanted) and wanted[last + 1][0] == name and wanted[last + 1][1] - end <= GAP and wanted[last + 1][1] + wanted[last + 1][2] - start <= READ_BYTES:
                    last += 1
                    end = max(end, wanted[last][1] + wanted[last][2])
                if opened != name:
                    if source is not None:
                        source.close()
                    opened, source = name, fs.open_input_file(f"{base}/{name}")
                chunk = source.read_at(end - start, start)
                out = [parse(chunk[o - start : o - start + n]) for _, o, n in wanted[k : last + 1]]
                s, i = pa.string(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (i, s, s, i, i, s, s), strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
                k = last + 1
        if source is not None:
            source.close()

    return dealt.mapInArrow(read, RECORDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    index = write_archives(read_table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows for DuckDB; base32 takes five hex digits as four letters.
OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(5 * i + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * j AS INT)) & 31) + 1 AS INT), 1)), '')), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM d
"""
