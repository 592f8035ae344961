"""WARC archives: a writer of one gzip member per record, and a sequential reader.

Writing: payload digests are counted first; of equal payloads of at least ``min_revisit`` bytes
the one with the smallest id is stored as a response, the others as revisits of it.  Each task
writes archives of bounded size, under a name of its own attempt, and reports them only when they
are closed; files of lost attempts are never in the manifest.  Reading: a task streams an archive
through incremental decompression, frames each record by its content length and verifies block
and payload digests.  Only one record is in memory at a time.

Paths are opened by pyarrow's file systems, so the shared folder may be any store that they know, by
its own name or by that of Spark's connector (``SCHEMES``).

Defined cases: a null payload counts as empty; a null URL is stored as an empty target; payloads
under ``min_revisit`` bytes are always responses; rows with a null id are responses that nothing
refers to; rows that repeat an id are stored each, and of equal payloads one row of the smallest
id is the response (ties by URL); a long payload is one record and is held whole by the task that
writes or reads it; only the three named columns are read, so others may bear any name; an empty table writes no archive and reads as no rows.  A broken digest or
frame raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidgraph.plans.storage import discard, materialize, new_path

MIN_REVISIT = 100
ARCHIVE_BYTES = 256 * 1024 * 1024
READ_BYTES = 256 * 1024
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


#: Schemes of Spark's connectors that pyarrow knows by another name; dbfs is mounted.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "dbfs:/": "/dbfs/"}


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path inside it of a path as Spark writes it."""
    for scheme, known in SCHEMES.items():
        if uri.startswith(scheme):
            uri = known + uri.removeprefix(scheme).lstrip("/")
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def _digest(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def _hex(labelled: str) -> str:
    text = labelled.removeprefix("sha256:")
    return base64.b32decode(text + "=" * (-len(text) % 8)).hex()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _clean(value: str) -> str:
    """A header value on one line: control characters and % are percent-coded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or c in "%\x7f" else c for c in value)


def page_record(page_id, url, payload: bytes, refers_to) -> bytes:
    digest, name = _digest(payload), "" if pd.isna(page_id) else str(int(page_id))
    revisit = not pd.isna(refers_to)
    block = b"" if revisit else payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}:{digest}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url or "")),
        ("Content-Type", "text/html; charset=utf-8"),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", _digest(block)),
        ("X-Page-Id", name),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-Id", str(int(refers_to)))]
    return record_bytes(headers, block)


def read_members(stream, size: int = READ_BYTES) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, in order."""
    data = b""
    while True:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            data = data or stream.read(size)
            if not data:
                if parts:
                    raise ValueError("archive ends within a record")
                return
            parts.append(inflate.decompress(data))
            data = inflate.unused_data
        yield parse_record(b"".join(parts))


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.decode().partition(":")
        headers[name.strip().lower()] = value.strip()
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("record length differs from its content length")
    block = rest[:length]
    if headers.get("warc-block-digest", _digest(block)) != _digest(block):
        raise ValueError("block digest differs")
    if headers["warc-type"] == "response" and headers.get("warc-payload-digest", _digest(block)) != _digest(block):
        raise ValueError("payload digest differs")
    return headers, block


_MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_store(folder)
        made, out, records, size, path = [], None, 0, 0, ""
        for batch in batches:
            for page_id, url, html, refers_to in batch[["page_id", "url", "html", "refers_to"]].itertuples(index=False):
                if out is None:
                    path, records, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                member = page_record(page_id, url, (html or "").encode("utf-8", "replace"), refers_to)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    made.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            made.append((path, records, size))
        yield pd.DataFrame(made, columns=["path", "records", "bytes"])

    return write


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` as archives in the shared folder; the manifest (path, records, bytes)."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    # A payload below the limit has no digest here and so never meets another one in the join.
    long_enough = F.when(F.octet_length(payload) >= min_revisit, F.sha2(payload, 256))
    counted = rows.select("page_id", long_enough.alias("digest")).where("digest IS NOT NULL AND page_id IS NOT NULL")
    first = counted.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first.select("digest", "first", "n"), "payloads")
    # Only rows with a digest are joined: those without would all meet in one partition.
    keyed = rows.withColumn("digest", long_enough)
    alone = keyed.where("digest IS NULL").select("*", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("n"))
    joined = keyed.where("digest IS NOT NULL").join(first, "digest", "left").select(*alone.columns).unionByName(alone)
    repeats = first.join(counted, "digest").where("page_id = first").groupBy("digest").count().where("count > 1")
    joined = joined.withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))
    if not repeats.isEmpty():  # rows that repeat the smallest id: one of them stays the response
        joined = _one_response(joined, repeats)
    folder = new_path(spark, "warc")
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    manifest = materialize(joined.select("page_id", "url", "html", "refers_to").mapInPandas(_writer(folder, archive_bytes), _MANIFEST), "manifest")
    discard(spark, first)
    return manifest.withColumn("path", F.concat(F.lit(folder + "/"), F.element_at(F.split("path", "/"), -1)))


def _one_response(joined: DataFrame, repeats: DataFrame) -> DataFrame:
    """Among rows of the smallest id of a payload, which are equal but for the URL, all but the first become revisits."""
    own = F.col("page_id") == F.col("first")
    again = joined.where(own).join(repeats.select("digest"), "digest", "left_semi")
    place = F.row_number().over(_window())
    again = again.withColumn("place", place).withColumn("refers_to", F.when(F.col("place") > 1, F.col("first"))).drop("place")
    rest = joined.where(own).join(repeats.select("digest"), "digest", "left_anti")
    return joined.where(~own | own.isNull()).unionByName(rest).unionByName(again)


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("digest", "page_id").orderBy("url")


_RECORD = T.StructType(
    [T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("payload", T.BinaryType()))]
)


def _long(value: str | None) -> int | None:
    return int(value) if value else None


def _reader(with_payload: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import urllib.parse

        for batch in batches:
            for path in batch.path:
                store, inside = open_store(path)
                rows, held = [], 0
                with store.open_input_stream(inside, compression=None) as stream:
                    for h, block in read_members(stream):
                        rows.append((_long(h.get("x-page-id")), urllib.parse.unquote(h["warc-target-uri"]), int(h["x-payload-length"]), _hex(h["warc-payload-digest"]), h["warc-type"], _long(h.get("x-refers-to-page-id")), block if with_payload else None))
                        held += len(block)
                        if len(rows) >= 2000 or with_payload and held > 16_000_000:
                            yield _records(rows)
                            rows, held = [], 0
                if rows:
                    yield _records(rows)

    return read


def _records(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_RECORD.names)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(spark: SparkSession, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in ``manifest``, one task per archive.

    A record without a payload in the archive (a revisit) has an empty payload here.
    """
    paths = manifest.select("path").repartition(max(1, manifest.count()))
    records = paths.mapInPandas(_reader(with_payload), _RECORD)
    return records if with_payload else records.drop("payload")


ORACLE = """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), keyed AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM sized
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM keyed
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM firsts
"""
