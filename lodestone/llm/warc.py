"""WARC archives: a writer, and a splittable reader.

The writer gives each page one record in a gzip member of its own.  Of pages with equal
payloads the one with the largest page_id is a response; the others are revisits that name
it and carry no payload.  Every task writes one archive to a shared folder, under a name
made of its partition, first to a temporary name, so that a repeated task replaces its own
file with the same bytes.

The reader needs no index: tasks get byte ranges of the archives, look for the gzip magic
in them, accept a candidate only if it inflates to a WARC header, and own the records that
start inside their range, reading past its end to finish the last one; the search goes on
behind a record, not in it.  The list of archives and their ranges stays in Spark.

Defined results: null html is an empty payload; null page_ids are kept (they refer to the
largest page_id of their payload, if any is not null); rows with the same page_id and
payload are all responses where they are the largest; an empty table writes no archive and
gives an empty result; a very long payload is one record, read whole by the task that owns
it; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import cut, shared_dir

MAGIC = b"\x1f\x8b\x08"
SPLIT = 16 << 20
LEAST = 0
#: Into how many parts the pages of one payload are split to meet its response.
SALT = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "path string, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def line(value: str) -> str:
    """A header value on one line; percent signs and line ends are percent-encoded."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member.  Its id is made of page and payload, so that
    writing again gives the same bytes."""
    digest = digest32(payload)
    body = payload if kind == "response" else b""
    if kind == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + body
    else:
        block = b"HTTP/1.1 200 OK\r\n\r\n"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}"] + [f"X-Refers-To-Page: {refers_to}"] * (refers_to is not None)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n") + pack.flush()


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages with record_type and refers_to.  Only digests and page_ids are grouped; a
    payload that many pages share is combined before the shuffle, and its pages then meet
    SALT copies of the outcome."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).alias("_s")
    keyed = pages.select("page_id", "url", "html", F.unhex(F.sha1(payload)).alias("_d"), F.octet_length(payload).alias("_n"), salt)
    shared = keyed.filter(F.col("_n") >= least).groupBy("_d").agg(F.max("page_id").alias("_top"), F.count("*").alias("_c")).filter("_c > 1")
    shared = shared.select(F.col("_d").alias("_k"), "_top", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_t"))
    joined = keyed.join(shared, (F.col("_d") == F.col("_k")) & (F.col("_s") == F.col("_t")) & (F.col("_n") >= least), "left")
    revisit = F.col("_k").isNotNull() & F.col("_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_top"))
    return joined.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_top")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes archives to a shared folder (a URI) and gives (path, size) of each, one
    for each partition that has rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.warc.gz"
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        temporary = posixpath.join(root, f"_{name}.{context.taskAttemptId()}")
        sink, size = None, 0
        for batch in batches:
            for page_id, url, html, kind, to in zip(*(batch[c] for c in ("page_id", "url", "html", "record_type", "refers_to")), strict=True):
                if sink is None:
                    sink = store.open_output_stream(temporary)
                made = record(number(page_id), url, (html or "").encode("utf-8", "replace"), kind, number(to))
                sink.write(made)
                size += len(made)
        if sink is not None:
            sink.close()
            store.move(temporary, posixpath.join(root, name))
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "size": [size]})

    cast = [F.col(c).cast("string").alias(c) if c in ("page_id", "refers_to") else c for c in ("page_id", "url", "html", "record_type", "refers_to")]
    return cut(roles(pages, least).select(*cast).mapInPandas(run, "path string, size long"))


def number(x) -> int | None:
    return None if x is None or x != x else int(x)


def headers(raw: bytes) -> dict[str, str] | None:
    """The header fields if the bytes begin a WARC record."""
    if not raw.startswith(b"WARC/1."):
        return None
    top, end, _ = raw.partition(b"\r\n\r\n")
    if not end:
        return None
    fields = [x.split(": ", 1) for x in top.decode("utf-8", "replace").split("\r\n")[1:]]
    return {k.lower(): v for k, v in (f for f in fields if len(f) == 2)}


def member(source, at: int, size: int) -> tuple[dict[str, str], bytes, int] | None:
    """The record whose gzip member starts at a byte, and the byte after it, or None if
    none starts there."""
    inflate, raw, place = zlib.decompressobj(31), io.BytesIO(), at
    first = True
    while place < size and not inflate.eof:
        chunk = source.read_at(min(1 << 16 if not first else 1 << 12, size - place), place)
        place += len(chunk)
        try:
            raw.write(inflate.decompress(chunk))
        except zlib.error:
            return None
        if first and raw.tell() >= 7 and not raw.getvalue().startswith(b"WARC/1."):
            return None
        first = False
    if not inflate.eof:
        return None
    data = raw.getvalue()
    found = headers(data)
    return (found, data.partition(b"\r\n\r\n")[2], place - len(inflate.unused_data)) if found else None


def scan(path: str, start: int, end: int) -> Iterator[tuple]:
    """Records that start in [start, end) of an archive."""
    store, local = fs.FileSystem.from_uri(path)
    with store.open_input_file(local) as source:
        size = source.size()
        at, end = start, min(end, size)
        step = 1 << 12  # A record mostly follows the one before, so little is read to see it.
        while at < end:
            window = source.read_at(min(step, end - at + len(MAGIC) - 1), at)
            k = window.find(MAGIC)
            if k < 0 or at + k >= end:
                at += max(1, len(window) - len(MAGIC) + 1)
                step = min(1 << 20, 4 * step)
                continue
            got = member(source, at + k, size)
            if got is None:
                at += k + 1
                continue
            yield at + k, *got[:2]
            at, step = got[2], 1 << 12


def read(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """RECORD rows of archives (path, size), a task for each byte range."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start")
    ranges = archives.filter("size > 0").select("path", "size", starts).select("path", "start", F.least("size", F.col("start") + split).alias("end"))
    tasks = archives.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]

        def frame(rows):
            return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "offset": "int64", "payload_bytes": "int64"})

        for batch in batches:
            for path, start, end in zip(batch["path"], batch["start"], batch["end"], strict=True):
                rows = []
                for offset, head, block in scan(path, int(start), int(end)):
                    kind = head["warc-type"]
                    payload = block[: int(head["content-length"])].partition(b"\r\n\r\n")[2]
                    n, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != n or digest32(payload) != digest):
                        raise ValueError(f"{path} at {offset}: the payload doesn't fit its digest")
                    url = head.get("warc-target-uri")
                    rows.append((path, offset, _int(head.get("x-page-id")), None if url is None else unline(url), kind, n, digest, _int(head.get("x-refers-to-page")), payload if kind == "response" else None))
                    if len(rows) == 500:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    return ranges.repartition(max(1, int(tasks)), "path", "start").mapInPandas(run, RECORD)


def _int(x: str | None) -> int | None:
    return None if x is None else int(x)


def archive(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = "file://" + folder if folder.startswith("/") else folder.replace("file:/", "file:///", 1)
    return read(write(pages, folder, least))
