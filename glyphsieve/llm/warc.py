"""WARC archives: writing, normalising a monolithic gzip stream, and reading back by index.

write() lays pages down as archives of one gzip stream each. normalise() inflates such a stream once, from start to end,
rewrites every record as a gzip member of its own and writes a sidecar index (offset, length and id of each member).
read() opens members by that index. Files go through the file system of the shared folder (local or any that pyarrow
opens); a task writes under a name of its own and only the files of tasks that succeeded are listed, so tasks may be
repeated. Everything streams: no task holds more than a record and a buffer.

Of records with equal payloads of min_revisit bytes or more, those of the largest page id are responses and the others
revisits of it; smaller ones are responses. Which payloads recur is one aggregation over digests, without the payloads.

Defined results: a null html has an empty payload; a null page id counts as less than any other; rows that repeat their
page id and payload are all responses where that id is the largest; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remove, shared_dir, table

MIN_REVISIT = 1000
BUFFER = 1 << 20
DATE = "2024-01-01T00:00:00Z"


def _open(path: str, mode: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    if mode == "w":
        system.create_dir(name.rpartition("/")[0], recursive=True)
        return system.open_output_stream(name, compression=None)
    return system.open_input_file(name) if mode == "r" else system.open_input_stream(name, compression=None)


def _drop(path: str) -> None:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    system.delete_file(name)


def record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit keeps the response's HTTP header but not its payload."""
    digest = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda i: "none" if i is None else str(i)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name(page_id)}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + " ".join((url or "").split()),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[6:6] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{name(refers_to)}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict, bytes]:
    """Header fields (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    return fields, rest[: int(fields["content-length"])]


def records(stream) -> object:
    """The raw records of a gzip stream of one or more members, one at a time, inflated once."""
    inflate, held = zlib.decompressobj(31), bytearray()
    start, want, raw = 0, None, b""
    while True:
        while True:
            if want is None:
                end = held.find(b"\r\n\r\n", start)
                if end < 0:
                    break
                head = bytes(held[start:end]).lower()
                at = head.index(b"\r\ncontent-length:") + 17
                want = end + 4 - start + int(head[at:].split(b"\r\n", 1)[0]) + 4
            if len(held) - start < want:
                break
            yield bytes(held[start : start + want])
            start, want = start + want, None
        del held[:start]
        start = 0
        while not raw and inflate.eof is False:
            raw = stream.read(BUFFER)
            if not raw:
                break
            raw = inflate.unconsumed_tail + raw
        if not raw:
            if held:
                raise ValueError("the archive ends within a record")
            return
        held += inflate.decompress(raw, BUFFER * 4)
        raw = inflate.unconsumed_tail
        if inflate.eof:
            raw = inflate.unused_data or stream.read(BUFFER)
            if raw:
                inflate = zlib.decompressobj(31)


def revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Rows (page_id, digest, refers_to): the pages whose payload a larger page id has too."""
    own = pages.select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).where(F.length("payload") >= min_revisit).select("page_id", F.sha1("payload").alias("digest"))
    own, at = cut(own.distinct(), "digests")
    tops, _ = cut(own.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "recurring")
    return own.join(tops, "digest").where(F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to")))


def write(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write one monolithic archive a task. Rows (path, records)."""
    again = revisits(pages, min_revisit).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    own = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    typed = own.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.sha1("payload") == F.col("_digest")), "left").select("page_id", "url", "payload", "refers_to", F.col("_digest").isNotNull().alias("revisit"))

    def run(batches):
        path, out, n = f"{folder}/whole/{uuid.uuid4().hex}.warc.gz", None, 0
        deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
        for b in batches:
            for row in zip(*(b.column(k) for k in range(5)), strict=True):
                out = out or _open(path, "w")
                out.write(deflate.compress(record(*(x.as_py() for x in row))))
                n += 1
        if out:
            out.write(deflate.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return typed.mapInArrow(run, "path string, records bigint")


def normalise(archives: DataFrame, folder: str, drop_source: bool = False) -> DataFrame:
    """Rewrite each archive with a gzip member a record and a sidecar index. Rows (path, index, records)."""

    def run(batches):
        for b in batches:
            for source in b.column(0).to_pylist():
                path = f"{folder}/members/{uuid.uuid4().hex}.warc.gz"
                index, at, n = path.removesuffix(".warc.gz") + ".cdx", 0, 0
                with _open(source, "s") as stream, _open(path, "w") as out, _open(index, "w") as side:
                    for raw in records(stream):
                        deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
                        member = deflate.compress(raw) + deflate.flush()
                        out.write(member)
                        name = parse_id(raw)
                        side.write(f"{at}\t{len(member)}\t{name}\n".encode())
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([index]), pa.array([n], pa.int64())], ["path", "index", "records"])

    return archives.select("path").mapInArrow(run, "path string, index string, records bigint")


def parse_id(raw: bytes) -> str:
    at = raw.index(b"WARC-Record-ID: <") + 17
    return raw[at : raw.index(b">", at)].decode()


def read(archives: DataFrame) -> DataFrame:
    """A row per record of normalised archives, each member opened by its index entry: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    page = lambda x: None if x in (None, "<urn:page:none>") else int(x[10:-1])

    def run(batches):
        for b in batches:
            for path, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with _open(index, "s") as side:
                    entries = [x.split(b"\t") for x in side.read().splitlines()]
                with _open(path, "r") as file:
                    for k in range(0, len(entries), 256):
                        rows = []
                        for at, size, _ in entries[k : k + 256]:
                            file.seek(int(at))
                            fields, block = parse(zlib.decompress(file.read(int(size)), 31))
                            head, _, payload = block.partition(b"\r\n\r\n")
                            length = int(head.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                            digest = fields["warc-payload-digest"].removeprefix("sha1:")
                            kind = fields["warc-type"]
                            if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                                raise ValueError(f"{path} at {at.decode()}: the payload is not what its header says")
                            rows.append((page(fields["warc-record-id"]), fields["warc-target-uri"], payload if kind == "response" else None, length, digest, kind, page(fields.get("warc-refers-to"))))
                        kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("path", "index").mapInArrow(run, "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Pages as archives in the shared folder, normalised and read back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/glyphsieve/warc-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    whole, _ = cut(write(pages, folder, min_revisit), "whole")
    remove(spark)  # the payloads' shuffle files
    spread = lambda x: x.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")
    members, _ = cut(normalise(spread(whole), folder), "members")
    remove(spark, f"{folder}/whole")
    return read(spread(members))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY sha1(h)) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to FROM q
"""
