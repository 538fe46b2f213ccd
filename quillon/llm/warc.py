"""WARC/1.1 archives: a writer of one gzip member for each record, and a splittable reader.

A reader task takes a byte range of an archive, scans it for the gzip magic, and takes as
member starts only places whose bytes inflate to a WARC version. It owns the records that
start inside its range and reads the last of them beyond its end. So one archive can be
read by many tasks without an index. Headers may be of any length.

Records of equal payloads of at least ``LEAST`` bytes: the one with the largest page id is
a response, the others are revisits of it without a payload. Responses are written first, so
that a revisit refers to a record id that exists; page ids stand in fields of their own. A
block is an HTTP response; its body is the payload. Null html is an empty payload, null urls
are empty, null ids lose against any id. Rows that share id and payload are each a record;
those with the largest id are all responses. Other columns are ignored. A task holds one
record at a time and 4 MB of results; a record is read whole, however long.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved, sent

LEAST = 1000
SPLIT = 8 << 20
READ = 1 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
RECORD = b"WARC/1."
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"
#: Operators take no clock: the capture time of all records unless one is given.
DATE = "2024-01-01T00:00:00Z"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, local or remote."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def record(fields: list[tuple[str, str]], body: bytes) -> bytes:
    """One record as one gzip member."""
    head = VERSION + "".join(f"{a}: {b}\r\n" for a, b in fields).encode() + b"Content-Length: %d\r\n\r\n" % len(body)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head + body + b"\r\n\r\n") + z.flush()


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c >= " " and c != "\x7f")


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields and block of an inflated record."""
    if not raw.startswith(RECORD):
        return None
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    n = int(fields.get("content-length", 0))
    return fields, raw[end + 4 : end + 4 + n]


def payloads(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))


def revisits(pages: DataFrame) -> DataFrame:
    """Digest and size of payloads that more than one row has, with the largest id."""
    found = payloads(pages).select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("bytes"))
    return found.where(F.col("bytes") >= LEAST).groupBy("digest", "bytes").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("digest", "bytes", "original")


ARCHIVES = "file string, size long, records long, digest string, bytes long, record_id string"


def _write(rows: DataFrame, path: str, run_id: str, date: str) -> DataFrame:
    """An archive of each task's ``rows`` (page_id, url, html, digest, bytes, original, refers_to);
    ARCHIVES rows, with the record ids of responses that revisits may refer to."""

    def run(batches):
        store, folder = open_fs(path)
        context = TaskContext.get()
        store.create_dir(folder, recursive=True)
        name = f"{folder}/{run_id}-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        size = n = 0
        with store.open_output_stream(name, compression=None) as out:
            for b in batches:
                targets = []
                for page, url, html, digest, length, original, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    body, again = (html or "").encode(), refers is not None
                    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{n}')}>"
                    fields = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", _clean(url))]
                    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", HTTP), ("Quillon-Page-ID", "" if page is None else str(page)), ("Quillon-Payload-Length", str(length))]
                    if again:
                        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers), ("Quillon-Refers-To-Page", "" if original is None else str(original))]
                    elif original is not None:
                        targets.append((digest, length, record_id))
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
                    size += out.write(record(fields, head if again else head + body))
                    n += 1
                if targets:
                    digests, lengths, ids = zip(*targets, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), t) for t in (pa.string(), pa.int64(), pa.int64())] + [pa.array(digests), pa.array(lengths, pa.int64()), pa.array(ids)], names=names)
        if n:
            file = name if "://" not in path else f"{path.rstrip('/')}/{os.path.basename(name)}"
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size]), pa.array([n]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string())], names=names)

    names = [f.split()[0] for f in ARCHIVES.split(", ")]
    return saved(rows.select("page_id", "url", "html", "digest", "bytes", "original", "refers_to").mapInArrow(run, ARCHIVES), "archives")


def write_archives(pages: DataFrame, path: str, date: str = DATE) -> DataFrame:
    """Archives in folder ``path``, one for each task; returns (file, size, records). A file is
    written under a name of its attempt and only files of attempts that Spark took are in the
    list; others are deleted, so repeated tasks leave no record twice and no file behind."""
    spark = pages.sparkSession
    rows = payloads(pages).withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "bytes": F.octet_length("html").cast("long")})
    # tables of their own, so that the joins can part a payload of many rows
    twice = saved(revisits(pages), "revisits")
    rows = rows.join(sent(twice, 80), ["digest", "bytes"], "left")
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    run_id = uuid.uuid4().hex[:8]
    first = _write(rows.where(~again).withColumn("refers_to", F.lit(None).cast("string")), path, run_id, date)
    ids = saved(first.where("record_id IS NOT NULL").groupBy("digest", "bytes").agg(F.min("record_id").alias("refers_to")), "record-ids", max(1, twice.count()))
    bare = rows.where(again).withColumn("html", F.lit(None).cast("string"))
    second = _write(bare.join(sent(ids, 160), ["digest", "bytes"]), path, run_id, date)
    files = saved(first.where("file IS NOT NULL").unionByName(second.where("file IS NOT NULL")).select("file", "size", "records"), "files", 1)
    _drop_others(spark, path, run_id, files)
    return files


def _drop_others(spark, path: str, run_id: str, files: DataFrame) -> None:
    """Delete files of this run that are not in the list (a file a task), which failed attempts left."""
    taken = {os.path.basename(r["file"]) for r in files.select("file").collect()}
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.listStatus(folder) if store.exists(folder) else []:
        name = status.getPath().getName()
        if name.startswith(f"{run_id}-") and name not in taken:
            store.delete(status.getPath(), False)


def starts_in(source, lo: int, hi: int) -> Iterator[int]:
    """Places in lo..hi-1 where a record's gzip member starts."""
    at, tail = lo, b""
    while at < hi:
        source.seek(at)
        chunk = source.read(min(READ, hi - at + len(MAGIC) - 1))
        i = chunk.find(MAGIC)
        while i >= 0:
            if at + i < hi and _is_record(source, at + i):
                yield at + i
            i = chunk.find(MAGIC, i + 1)
        if len(chunk) < READ:
            return
        at += len(chunk) - len(MAGIC) + 1


def _is_record(source, at: int) -> bool:
    """Whether a member at this place begins with a WARC version; what follows may be of any
    length and is inflated with the member."""
    source.seek(at)
    z, head = zlib.decompressobj(31), b""
    try:
        while len(head) < len(RECORD) and not z.eof:
            more = z.unconsumed_tail or source.read(4096)
            if not more:
                break
            head += z.decompress(more, len(RECORD))
    except zlib.error:
        return False
    return head.startswith(RECORD)


def _member(source, at: int) -> bytes:
    source.seek(at)
    z, out = zlib.decompressobj(31), []
    while not z.eof:
        chunk = source.read(65536)
        if not chunk:
            raise EOFError(f"the member at {at} is cut off")
        out.append(z.decompress(chunk))
    return b"".join(out)


def read_archives(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """Records of archives (file, size): file, offset, record_id, type, url, page_id, digest,
    payload_length, refers_to (a record id), refers_to_page and payload (binary; none for revisits). The byte ranges are rows,
    dealt evenly to as many tasks."""
    table = files.where("size > 0").select("file", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(split))).alias("lo"), "size")
    table = table.select("file", "lo", F.least(F.col("lo") + split, "size").alias("hi"))
    ranges = files.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 0
    table = table.repartition(max(1, ranges))
    schema = "file string, offset long, record_id string, type string, url string, page_id string, digest string, payload_length long, refers_to string, refers_to_page string, payload binary"

    def batch(rows):
        columns = list(zip(*rows, strict=True))
        names = tuple(f.split()[0] for f in schema.split(", "))
        kinds = tuple({"offset": pa.int64(), "payload_length": pa.int64(), "payload": pa.binary()}.get(n, pa.string()) for n in names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches):
        for b in batches:
            for file, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, name = open_fs(file)
                with store.open_input_file(name) as source:
                    rows, held = [], 0
                    for at in starts_in(source, lo, hi):
                        if (parsed := parse(_member(source, at))) is None:
                            continue
                        f, block = parsed
                        kind = f.get("warc-type", "")
                        if f.get("content-type", "").startswith("application/http"):
                            block = block.partition(b"\r\n\r\n")[2]
                        rows.append((file, at, f.get("warc-record-id"), kind, f.get("warc-target-uri"), f.get("quillon-page-id") or None, f.get("warc-payload-digest", "").removeprefix("sha1:"), int(f.get("quillon-payload-length", len(block))), f.get("warc-refers-to"), f.get("quillon-refers-to-page") or None, None if kind == "revisit" else block))
                        held += len(block)
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return table.mapInArrow(run, schema)


def digest(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to. Of a
    response both figures are those of the payload read back."""
    response = F.col("type") == "response"
    return records.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to_page").cast("long").alias("refers_to"),
    )


def complete(found: DataFrame, files: DataFrame) -> DataFrame:
    """``found`` (a row for each record read), kept; fails unless it has as many rows as records
    were written to ``files``."""
    out = saved(found, "records")
    read, written = out.count(), files.agg(F.sum("records")).first()[0] or 0
    if read != written:
        raise ValueError(f"{read} records read of {written} written")
    return out


def sha1(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()


def positions(blob: bytes) -> np.ndarray:
    """Places of the gzip magic in a blob; for tests of the reader's validation."""
    found, i = [], blob.find(MAGIC)
    while i >= 0:
        found.append(i)
        i = blob.find(MAGIC, i + 1)
    return np.array(found, np.int64)


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, payload_bytes, max(page_id) AS o FROM p GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> o THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> o THEN o END AS refers_to
FROM p JOIN m USING (payload_digest, payload_bytes)
"""
