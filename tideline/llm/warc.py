"""WARC archives in which equal payloads are stored once: revisit records refer to the original response."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, as RFC 4122 gives it


def record_id(date: str, page_id, digest: str) -> str:
    """A record's id: a UUID named by the run's date and the record, so that a task that runs again writes the same."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{date}:page:{page_id}:{digest}')}>"


def clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.splitlines()) if value else ""


def record(page_id, url: str | None, payload: bytes | None, size: int, digest: str, refers_to, refers_uri: str | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload of size bytes, or (refers_to given) a revisit with the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(date, page_id, digest)}", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {clean(url)}"] if url else []), *([f"X-Page-ID: {page_id}"] if page_id is not None else []), f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(date, refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
        head += [f"WARC-Refers-To-Target-URI: {clean(refers_uri)}"] if refers_uri else []
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def gzipped(content: bytes) -> bytes:
    """One gzip member, without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def records(stream, piece: int = 1 << 20):
    """(headers, block) of each record of a file of gzip members, read piece by piece."""
    data, member, parts = b"", None, []
    while True:
        if not data:
            data = stream.read(piece)
            if not data:
                if member is not None:
                    raise ValueError("the archive ends inside a record")
                return
        member = member or zlib.decompressobj(31)
        parts.append(member.decompress(data))
        data = member.unused_data if member.eof else b""
        if member.eof:
            yield parsed(b"".join(parts))
            member, parts = None, []


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    return headers, rest[: int(headers["Content-Length"])]


def resolve_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, digest, refers_to and refers_uri of the pages that revisit another: equal payloads of at least least_bytes, another than the smallest page_id.

    Only headers move: digest, id and url. The smallest page of each digest is an aggregate that combines before
    the shuffle; digests that occur once drop out there; the rest join their pages, a payload with very many
    pages in parts. A null page_id is never an original unless all are null, and then nothing refers.
    """
    headers = pages.where(F.octet_length("_payload") >= least_bytes).select("page_id", "url", F.sha2("_payload", 256).alias("digest"))
    headers = common.written(headers, "warc-headers")
    first = headers.where("page_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("o"), F.count(F.lit(1)).alias("n"))
    nulls = headers.where("page_id IS NULL").select("digest").distinct()
    several = first.join(nulls.withColumn("_also", F.lit(True)), "digest", "left").where("n > 1 OR _also")
    originals = common.written(several.select("digest", F.col("o.page_id").alias("refers_to"), F.col("o.url").alias("refers_uri")), "warc-originals")
    met = headers.join(originals, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return met.select("page_id", "digest", "refers_to", "refers_uri").distinct()


def write_archives(pages: DataFrame, path: str, least_bytes: int = 100, date: str | None = None, file_bytes: int = 256 << 20) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) to gzip archives under path; returns the manifest: path, n_records.

    Payload: html in UTF-8, null as empty. Rows equal in page_id and payload, if it is the original, are all
    responses. Record ids and dates are fresh: date is the time of the call by default. Pages go to archives by page_id, and lie there in its order; an
    archive closes at file_bytes of records. Null ids and urls: the header is left out. Empty table: no archive.
    Other columns are ignored.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("_payload"))
    revisits = common.written(resolve_revisits(rows, least_bytes), "warc-revisits")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        made, parts, size = [], [], 0
        task = TaskContext.get().partitionId()

        def flush():
            nonlocal parts, size
            if parts:
                made.append((f"{path}/pages-{task:06d}-{len(made):04d}.warc.gz", len(parts)))
                common.write_file(made[-1][0], parts)
                parts, size = [], 0

        for batch in batches:
            for page_id, url, body, bytes_, digest, refers_to, refers_uri in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.append(gzipped(record(page_id, url, body, bytes_, digest, refers_to, refers_uri, date)))
                size += len(parts[-1])
                if size >= file_bytes:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "n_records"])

    keyed = rows.withColumns({"_id": F.coalesce("page_id", F.lit(0)), "_null": F.col("page_id").isNull(), "_digest": F.sha2("_payload", 256)})
    told = revisits.select(F.coalesce("page_id", F.lit(0)).alias("_id"), F.col("page_id").isNull().alias("_null"), F.col("digest").alias("_digest"), "refers_to", "refers_uri")
    # Placed by id and digest, so that neither copies of a payload nor rows without an id crowd one task.
    # A revisit's payload goes no further.
    joined = keyed.withColumn("_size", F.octet_length("_payload")).join(told, ["_id", "_null", "_digest"], "left").withColumn("_payload", F.when(F.col("refers_to").isNull(), F.col("_payload")))
    placed = joined.repartition("_id", "_null", "_digest").sortWithinPartitions("_null", "_id")
    return common.written(placed.select("page_id", "url", "_payload", "_size", "_digest", "refers_to", "refers_uri").mapInArrow(write, "path string, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records behind a manifest: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits).

    Digests of stored payloads are computed again and must agree. Null ids and urls come back null; an empty
    payload is an empty response. An empty manifest gives no row.
    """

    def read(batches):
        import pyarrow as pa

        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def out(rows):
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = common.filesystem(path)
                rows, size = [], 0
                with files.open_input_stream(at, compression=None) as f:
                    for headers, block in records(f):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        kind = headers["WARC-Type"]
                        if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: the payload of {headers['WARC-Record-ID']} isn't what its headers say")
                        number = lambda k, h=headers: int(h[k]) if k in h else None
                        rows.append((number("X-Page-ID"), headers.get("WARC-Target-URI"), kind, length, digest, number("X-Refers-To-Page-ID"), payload if kind == "response" else None))
                        size += len(payload)
                        if size > 8 << 20 or len(rows) >= 5000:
                            yield out(rows)
                            rows, size = [], 0
                yield out(rows)

    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(tasks, "path").mapInArrow(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
