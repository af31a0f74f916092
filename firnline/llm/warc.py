"""WARC archives: writing one gzip member per record, and a reader that splits files anywhere."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.text import col
from firnline.session import cut_lineage, scratch_path

#: Bytes of an archive after which a task starts another, and bytes of a range that one task scans.
ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 4 << 20
#: Bytes read at a time.
CHUNK = 1 << 20

# The start of a gzip member that is deflated, and what a record starts with.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
ANY_VERSION = b"WARC/1."
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A field of our own, as the format allows: the length of the payload that a revisit stands for.
LENGTH_FIELD = "X-Payload-Length"

_WRITTEN = "path string, size long, records long"
_RECORDS = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                      ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is one of this machine's mounts."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, kind: str, payload: bytes | None, payload_bytes: int, payload_digest: str,
           refers_to: int | None) -> bytes:
    """One record as a gzip member. Control characters and spaces in a url are percent-encoded."""
    fields = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
              "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest}",
              "Content-Type: application/http;msgtype=response"]
    if url is not None:
        fields.append("WARC-Target-URI: " + quote(url, safe="".join(chr(c) for c in range(33, 127) if chr(c) != "%")))
    if kind == "revisit":
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>",
                   f"{LENGTH_FIELD}: {payload_bytes}"]
    block = HTTP_HEAD + (payload if kind == "response" else b"")
    fields.append(f"Content-Length: {len(block)}")
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(VERSION + "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


#: Tasks that read ranges at most.
READERS = 1 << 15
#: Records whose block is an HTTP response, and those whose block is the payload itself.
HTTP, PLAIN = ("response",), ("resource", "conversion")
_PAGE = "<urn:page:"


def _page(name: str | None) -> int | None:
    """The number in an identifier of ours; None for others."""
    number = name[len(_PAGE):-1] if name and name.startswith(_PAGE) else ""
    return int(number) if number.removeprefix("-").isdigit() else None


def parse(data: bytes) -> dict | None:
    """The fields of an unpacked record, or None if it isn't one.

    Field names may have any case. Records of other types than responses,
    resources, conversions and revisits have no payload; what a record does
    not say is None.
    """
    head, gap, block = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(ANY_VERSION):
        return None
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    fields = {name.strip().lower(): value.strip() for name, colon, value in lines if colon}
    kind, size = fields.get("warc-type"), fields.get("content-length", "")
    if kind is None or not size.isdecimal() or len(block) < int(size):
        return None
    block = block[:int(size)]
    payload = block.partition(b"\r\n\r\n")[2] if kind in HTTP else block if kind in PLAIN else None
    url, length = fields.get("warc-target-uri"), fields.get(LENGTH_FIELD.lower(), "")
    said = fields.get("warc-payload-digest")
    return {"page_id": _page(fields.get("warc-record-id")), "record_type": kind, "url": None if url is None else unquote(url),
            "payload_bytes": len(payload) if payload is not None else int(length) if length.isdecimal() else None,
            "payload_digest": digest(payload) if payload is not None else None if said is None else said.removeprefix("sha1:"),
            "refers_to": _page(fields.get("warc-refers-to")) if kind == "revisit" else None, "payload": payload}


def _write(folder: str, archive_bytes: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Names are new in every attempt; only archives that a finished attempt reports are read.
        files, root = open_fs(folder)
        files.create_dir(root, recursive=True)
        out, path, size, count, done = None, "", 0, 0, []

        def close():
            if out is not None:
                out.close()
                done.append((path, size, count))
        for part in parts:
            for r in part.to_pylist():
                data = record(r["page_id"], r["url"], "response" if r["refers_to"] is None else "revisit", r["payload"],
                              r["payload_bytes"], base64.b32encode(bytes.fromhex(r["sha1"])).decode(), r["refers_to"])
                if out is None or size >= archive_bytes:
                    close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, path, size, count = files.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}", 0, 0
                out.write(data)
                size += len(data)
                count += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*done)) or [[], [], []], (pa.string(), pa.int64(), pa.int64()))],
                                         ["path", "size", "records"])
    return run


def write_warc(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, min_payload: int = 0) -> DataFrame:
    """Write a record for every row of ``pages(page_id, url, html)``; returns (path, size, records) of the archives.

    Of rows with equal payloads of ``min_payload`` bytes or more the one with
    the smallest page_id is a response, the others are revisits of it; rows
    without a page_id and repeated rows of the smallest id are responses. A
    null html is an empty payload. ``folder`` has to be shared; without one it
    is a new one in the scratch folder.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    payload = F.coalesce(col(pages, "html"), F.lit("")).cast("binary")
    rows = pages.select(col(pages, "page_id").cast("long").alias("page_id"), col(pages, "url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # Only digests with more than one id are joined; what they carry is one row for each.
    first = (rows.where(F.col("payload_bytes") >= min_payload).groupBy("sha1")
             .agg(F.min("page_id").alias("first"), F.max("page_id").alias("_last")).where("first < _last").select("sha1", "first"))
    first = cut_lineage(first)
    marked = rows.join(first, "sha1", "left").select("page_id", "url", "sha1", "payload_bytes", F.when(
        F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"), "payload")
    marked = marked.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    return cut_lineage(marked.mapInArrow(_write(folder, archive_bytes), _WRITTEN))


class Scan:
    """Reads a file from a position on, in chunks."""

    def __init__(self, source, size: int, at: int):
        self.source, self.size, self.at, self.data = source, size, at, b""

    def more(self) -> bool:
        """One more chunk behind what is held; False at the end of the file."""
        start = self.at + len(self.data)
        if start >= self.size:
            return False
        self.source.seek(start)
        self.data += self.source.read(min(CHUNK, self.size - start))
        return True

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n

    def member(self) -> tuple[bytes, int] | None:
        """(unpacked bytes, packed length) of the gzip member at the current place; None if there is none.

        A place is only taken for a member if its head unpacks to the start of
        a record, its check sum holds and a further member or the end follows.
        """
        press, used, out, known = zlib.decompressobj(31), 0, [], False
        try:
            while not press.eof:
                if used == len(self.data) and not self.more():
                    return None
                out.append(press.decompress(self.data[used:used + CHUNK]))
                used = min(used + CHUNK, len(self.data))
                if not known and sum(map(len, out)) >= len(ANY_VERSION):
                    if not b"".join(out).startswith(ANY_VERSION):
                        return None
                    known = True
        except zlib.error:
            return None
        length = used - len(press.unused_data)
        while len(self.data) < length + len(MAGIC) and self.more():
            pass
        after = self.data[length:length + len(MAGIC)]
        return (b"".join(out), length) if known and (not after or after == MAGIC) else None


def records_in(source, size: int, start: int, end: int) -> Iterator[dict]:
    """The records whose first byte is in [start, end) of an open archive of ``size`` bytes."""
    scan = Scan(source, size, start)
    while scan.at < end:
        while len(scan.data) < len(MAGIC) and scan.more():
            pass
        at = scan.data.find(MAGIC)
        if at < 0:
            if len(scan.data) < len(MAGIC):
                return
            scan.drop(len(scan.data) - len(MAGIC) + 1)
            continue
        scan.drop(at)
        if scan.at >= end:
            return
        found = scan.member()
        fields = parse(found[0]) if found else None
        if fields is None:
            scan.drop(1)
        else:
            yield fields
            scan.drop(found[1])


def _read(with_payload: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f for f in _RECORDS if with_payload or f.name != "payload"]
        schema = pa.schema(names)
        for part in parts:
            for r in part.to_pylist():
                files, path = open_fs(r["path"])
                held, size = [], 0
                with files.open_input_file(path) as source:
                    for x in records_in(source, r["size"], r["start"], r["end"]):
                        held.append({f.name: x[f.name] for f in names})
                        size += len(x["payload"] or b"") if with_payload else 256
                        if size >= CHUNK:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
    return run


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of ``archives(path, size)``: page_id, record_type, url, payload_bytes, payload_digest, refers_to, payload.

    Every file is cut into ranges of ``split_bytes``, each a row of a task. A
    range yields the records that start in it, wherever they end. Digests of
    responses are computed from what was read. The payload of a revisit is null.
    Any WARC/1 version and record type is read; ids that are not ours are null.
    """
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    ranges = archives.where("size > 0").select("path", "size", cuts)
    ranges = ranges.withColumn("end", F.least(F.col("start") + split_bytes, F.col("size")))
    # A number of tasks is asked for, since the rows of the ranges are too small for Spark to keep them apart by itself.
    n = archives.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    spread = ranges.repartition(int(min(n, READERS)), "path", "start")
    schema = "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long"
    return spread.mapInArrow(_read(with_payload), schema + ", payload binary" * with_payload)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of the archives in a folder, by Spark's own listing; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", F.col("length").alias("size"))


def round_trip(pages: DataFrame) -> DataFrame:
    return read_warc(write_warc(pages), with_payload=False).drop("url")
