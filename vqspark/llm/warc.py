"""WARC archives whose repeated payloads are revisit records, written and read by Spark.

Headers (id, digest, length) are shuffled by digest and reduced to one original
per repeated payload; pages join that, and each becomes a response or a revisit
record with fresh headers. Each task writes its records into files of bounded
size, a gzip member for each record and a ``warcinfo`` record first, so readers
can begin at any record. Files of attempts that didn't finish are removed. They
are read back as wholes and cut by Content-Length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vqspark.llm.graph import cut, remove, shared_dir

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records after which a file ends; only a single record may be larger.
FILE_BYTES = 32 << 20
#: Repeated payloads up to this many (60 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: base 32 in digits 0-9A-V, renamed."""
    hexa = F.sha1(payload)
    cuts = ((1, 15, 12), (16, 15, 12), (31, 10, 8))
    digits = [F.lpad(F.conv(F.substring(hexa, a, n), 16, 32), w, "0") for a, n, w in cuts]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _prepared(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.monotonically_increasing_id().alias("row"))
    return own.withColumns({"digest": payload_digest(F.col("html")), "size": F.octet_length("html").cast("long")})


def resolve_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``record_type``, ``refers_to`` and ``original`` (whether others may refer to it) to rows of ``page_id, row, digest, size``."""
    heads = pages.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "row", "digest", "size")
    # of rows that repeat the smallest page_id, the first one is the original
    alike = heads.groupBy("digest", "size", "page_id").agg(F.count("*").alias("same"), F.min("row").alias("row"))
    nameless = pages.where((F.col("size") >= min_bytes) & F.col("page_id").isNull()).select("digest", "size", F.lit(1).cast("long").alias("more"))
    firsts = alike.groupBy("digest", "size").agg(F.min(F.struct("page_id", "same", "row")).alias("x"), F.sum("same").alias("n"))
    firsts = firsts.join(nameless.groupBy("digest", "size").agg(F.sum("more").alias("more")), ["digest", "size"], "left")
    firsts = firsts.where(F.col("n") + F.coalesce("more", F.lit(0)) > 1).select("digest", "size", F.col("x.page_id").alias("first"), F.when(F.col("x.same") > 1, F.col("x.row")).alias("first_row"))
    firsts = cut(firsts)
    few = firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = pages.join(F.broadcast(firsts) if few else firsts, ["digest", "size"], "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first")) & (F.col("first_row").isNull() | (F.col("row") == F.col("first_row")))
    again = F.col("first").isNotNull() & ~is_first
    return joined.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first")), "original": F.col("first").isNotNull() & is_first}).drop("first", "first_row")


# ---------------------------------------------------------------- writing
def _name(page_id: int | None, digest: str, row: int | None = None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{digest}{'' if row is None else f':{row}'}>"


def _head(kind: str, name: str, date: str, fields: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + END).encode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, row: int, kind: str, refers_to: int | None, original: bool, date: str) -> bytes:
    """A record with its closing separator. All records have names of their own; the original's follows from its page and digest."""
    url = re.sub(r"[\x00-\x1f\x7f]", "%20", url) if url else "urn:x-page:unknown"
    fields = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    block = HTTP.encode()
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to, digest))]
    else:
        block += payload
    fields.append(("Content-Type", "application/http; msgtype=response"))
    return _head(kind, _name(page_id, digest, None if original else row), date, fields, len(block)) + block + END.encode()


def _store(path: str):
    """``(file system, path in it)``; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _write(path: str, date: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        context = TaskContext.get()
        stem, names, out, held, records = f"part-{context.partitionId():06d}-{context.taskAttemptId()}", [], None, 0, 0
        try:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    data = record_bytes(*row, date)
                    if out is not None and held + len(data) > size:
                        out.close()
                        out = None
                    if out is None:
                        names.append(f"{stem}-{len(names):04d}.warc.gz")
                        store.create_dir(folder, recursive=True)
                        out, held = store.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                        info = b"software: vqspark\r\nformat: WARC File Format 1.1\r\n"
                        head = _head("warcinfo", f"<urn:x-file:{names[-1]}>", date, [("WARC-Filename", names[-1]), ("Content-Type", "application/warc-fields")], len(info))
                        out.write(gzip.compress(head + info + END.encode(), 6, mtime=0))
                    out.write(gzip.compress(data, 6, mtime=0))
                    held += len(data)
                    records += 1
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return run


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Writes a record for each row into gzip archives in the folder ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes, that with the
    smallest page_id is the response (of rows that repeat it the first one), the
    others revisit it; smaller ones are responses. A null html is an empty
    payload, a null url gets a placeholder, a null page_id is never the original
    where another row has an id. Other columns are not looked at. A file ends
    before it would hold more than ``file_bytes`` of records; a payload of any
    length is one record.
    """
    typed = resolve_revisits(_prepared(pages, id_col, url_col, html_col), min_bytes)
    own = typed.select("page_id", "url", "html", "digest", "row", "record_type", "refers_to", "original")
    names = {r["name"] for r in own.mapInArrow(_write(path, date, file_bytes), "name string").collect()}  # as many as files
    store, folder = _store(path)
    store.create_dir(folder, recursive=True)
    for file in store.get_file_info(fs.FileSelector(folder)):
        if file.base_name.endswith(".warc.gz") and file.base_name not in names:
            store.delete_file(file.path)


# ---------------------------------------------------------------- reading
class _Stream(io.RawIOBase):
    """What a gzip file of any number of members holds, without holding all of it."""

    STEP = 1 << 14

    def __init__(self, data: bytes):
        self.data, self.at, self.engine, self.begun = memoryview(data), 0, zlib.decompressobj(31), False

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            left = self.engine.unconsumed_tail
            if not left:
                left = self.data[self.at : self.at + self.STEP]
                self.at += len(left)
                self.begun |= bool(len(left))
            out = self.engine.decompress(left, len(buffer))
            if self.engine.eof:  # what follows in this step is the next member's
                self.at -= len(self.engine.unused_data)
                self.engine, self.begun = zlib.decompressobj(31), False
            elif not out and not len(left):
                if self.begun:
                    raise ValueError("the archive is cut short")
                return 0  # the file ended with its last member
            if out:
                buffer[: len(out)] = out
                return len(out)


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of each record of one gzip archive."""
    if not data:
        return
    stream = io.BufferedReader(_Stream(data), 1 << 18)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode("utf-8").partition(":")
            headers[key] = value.strip(" \r\n")
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != END.encode():
            raise ValueError("a record doesn't end where its length says")
        yield headers, block


def _page_of(name: str) -> int | None:
    page = name.removeprefix("<urn:x-page:").partition(":")[0]
    return None if page == "null" else int(page)


def _parse(with_payload: bool):
    names = ["page_id", "url", "record_type", "record_name", "refers_name", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for data in batch.column(0):
                for head, block in records_of(data.as_buffer().to_pybytes()):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload = size = None
                    if head["WARC-Type"] == "response":
                        payload = block.partition(END.encode())[2]
                        size = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{head['WARC-Record-ID']} doesn't have the payload of its digest")
                    refers = head.get("WARC-Refers-To")
                    name = head["WARC-Record-ID"]
                    rows.append((_page_of(name), head["WARC-Target-URI"], head["WARC-Type"], name, refers, _page_of(refers) if refers else None, digest, size, payload if with_payload else None))
                    held += len(block) if with_payload else 200
                    if held > 16 << 20:
                        yield flush(rows)
                        rows, held = [], 0
            if rows:
                yield flush(rows)

    return run


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in ``path``, revisits resolved to the response they refer to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    schema = "page_id long, url string, record_type string, record_name string, refers_name string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    records = files.mapInArrow(_parse(with_payload), schema)
    if not with_payload:
        records = cut(records)
    originals = records.where("record_type = 'response'").groupBy(F.col("record_name").alias("refers_name"))
    originals = originals.agg(F.max("payload_bytes").alias("own_bytes"), *([F.first("payload").alias("own_payload")] if with_payload else []))
    revisits = records.where("record_type = 'revisit'").join(originals, "refers_name", "left")
    revisits = revisits.withColumn("payload_bytes", F.col("own_bytes"))
    if with_payload:
        revisits = revisits.withColumn("payload", F.col("own_payload"))
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    return records.where("record_type = 'response'").select(columns).union(revisits.select(columns))


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives of ``pages`` in the shared folder, reads their headers back and removes the archives."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, min_bytes)
    try:
        return read_archive(spark, path).drop("url")
    finally:
        remove(spark, path)
