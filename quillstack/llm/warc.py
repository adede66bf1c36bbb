"""WARC archives: writing with revisit records, and a salvage reader.

Writing: one gzip member a record, one archive a task, put in place by a rename after it is complete, so a
task that is run again replaces nothing half-written; only archives named in the tasks' own results are
read. Pages with equal payloads share one response record, that of the least page id; the others are
revisit records that point to it and carry the HTTP header alone.

Reading: members and plain records are taken one by one. If a check fails (magic, inflation, checksum,
length, block digest) the reader looks for the next valid member or version line, goes on there, and
reports the bytes in between as a quarantined gap. It works off files of any size from front to back.

Cases: null html is an empty payload; null ids come last and refer to nothing by name; of rows that repeat
in full one is the response; null urls leave the target out; empty tables give no archives and no rows. Columns besides
page_id, url and html are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import logging
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import attach, located, shared_dir, small_batches, stage, table

log = logging.getLogger(__name__)
#: Payloads of fewer bytes are never made revisits.
MIN_REVISIT_BYTES = 0
LAST_ID = (1 << 63) - 1
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
VERSION_LINE = b"WARC/1."
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
HEADER_LIMIT, READ = 1 << 16, 1 << 20
ID = re.compile(r"<urn:page:(-?\d*):(\d+)>")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: str, serial: int, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record as a gzip member; refers_to: the response's id, for revisits."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = [
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <urn:page:{page}:{serial}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url else []),
        *([f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"] if refers_to else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress(VERSION + "\r\n".join(head).encode() + END + block + END, 1, mtime=0)


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    start: int
    end: int
    why: str


class Broken(Exception):
    pass


def parsed(data: bytes, start: int, end: int) -> Record:
    """A record from its whole bytes, checked."""
    head, found, rest = data.partition(END)
    if not data.startswith(VERSION_LINE) or not found:
        raise Broken("no header")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Broken("bad header line")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdecimal() or len(rest) != int(length) + len(END) or not rest.endswith(END):
        raise Broken("wrong length")
    block = rest[: int(length)]
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != digest(block):
        raise Broken("wrong digest")
    return Record(start, end, headers, block)


class Salvage:
    """Records and gaps of one archive, given a file that can seek and its size."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, self.size - at))

    def _member(self, at: int) -> Record:
        """The gzip member that begins here."""
        inflate, out, place = zlib.decompressobj(31), [], at
        while not inflate.eof:
            piece = self._read(place, READ)
            if not piece:
                raise Broken("cut off")
            place += len(piece)
            try:
                out.append(inflate.decompress(piece))
            except zlib.error as e:
                raise Broken("inflation") from e
        return parsed(b"".join(out), at, place - len(inflate.unused_data))

    def _plain(self, at: int) -> Record:
        """The uncompressed record that begins here."""
        head = self._read(at, HEADER_LIMIT)
        stop = head.find(END)
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r$", head[: stop + 1]) if stop >= 0 else None
        if not length:
            raise Broken("no header")
        whole = stop + len(END) + int(length[1]) + len(END)
        if at + whole > self.size:
            raise Broken("cut off")
        return parsed(self._read(at, whole), at, at + whole)

    def _next(self, at: int) -> int:
        """The next place where a member or a version line may begin."""
        keep = max(len(MAGIC), len(VERSION_LINE)) - 1
        while at < self.size:
            piece = self._read(at, READ + keep)
            places = [p for p in (piece.find(MAGIC), piece.find(VERSION_LINE)) if p >= 0]
            if places:
                return at + min(places)
            at += READ
        return self.size

    def __iter__(self) -> Iterator[Record | Gap]:
        at, gap, why = 0, -1, ""
        while at < self.size:
            try:
                lead = self._read(at, len(VERSION_LINE))
                found = self._member(at) if lead.startswith(MAGIC) else self._plain(at) if lead == VERSION_LINE else None
                if found is None:
                    raise Broken("no record")
            except Broken as e:
                if gap < 0:
                    gap, why = at, str(e)
                at = self._next(at + 1)
                continue
            if gap >= 0:
                yield Gap(gap, at, why)
                gap = -1
            yield found
            at = found.end
        if gap >= 0:
            yield Gap(gap, self.size, why)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) to archives in a folder; returns the staged list of paths and counts."""
    data = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", data.alias("data"), F.monotonically_increasing_id().alias("serial")).withColumn("sha", F.sha1("data"))
    key = F.struct(F.coalesce("page_id", F.lit(LAST_ID)).alias("page"), "serial")
    large = F.length("data") >= min_bytes
    firsts = stage(rows.where(large).groupBy("sha").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first.page", F.col("first.serial").alias("first_serial")))
    decided = attach(rows, firsts, "sha", ["page", "first_serial"])
    revisit = large & F.col("first_serial").isNotNull() & (F.col("serial") != F.col("first_serial"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    target = F.when(F.col("page") == LAST_ID, F.lit("")).otherwise(F.col("page").cast("string"))
    refers = F.when(revisit, F.concat(F.lit("<urn:page:"), target, F.lit(":"), F.col("first_serial").cast("string"), F.lit(">")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = located(folder)
        context = TaskContext.get()
        path, n, out = f"{root}/part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz", 0, None
        for batch in batches:
            for p, serial, url, payload, to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{path}.open", compression=None)
                out.write(record(p, serial, url, payload, to))
                n += 1
        if out is not None:
            out.close()
            store.move(f"{path}.open", path)
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    small_batches(pages.sparkSession)
    chosen = decided.select(page.alias("page"), "serial", "url", "data", refers.alias("refers"))
    return stage(chosen.mapInArrow(write, "path string, records bigint"))


READ_SCHEMA = "path string, start bigint, end bigint, problem string, record_type string, record_id string, refers_to string, payload_bytes bigint, payload_digest string"


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Records and gaps of archives (path): READ_SCHEMA, and payload (binary) if asked for. A gap has a problem and its bytes' range."""
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    schema = READ_SCHEMA + (", payload binary" if with_payload else "")

    def rows_of(path: str, store: fs.FileSystem) -> Iterator[tuple]:
        with store.open_input_file(path) as f:
            for found in Salvage(f, f.size()):
                if isinstance(found, Gap):
                    yield path, found.start, found.end, found.why, None, None, None, None, None, None
                    continue
                h = found.headers
                http, _, payload = found.block.partition(END)
                stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
                kind = h.get("warc-type")
                size = int(stated[1]) if kind == "revisit" and stated else len(payload)
                own = h.get("warc-payload-digest", "").removeprefix("sha1:") if kind == "revisit" else digest(payload)
                yield path, found.start, found.end, None, kind, h.get("warc-record-id"), h.get("warc-refers-to"), size, own, payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = located(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows_of(path, store):
                    held.append(row if with_payload else row[:-1])
                    size += 200 + (len(row[-1] or b"") if with_payload else 0)
                    if size > 8 * READ:
                        yield packed(held)
                        held, size = [], 0
                if held:
                    yield packed(held)

    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], [*names, "payload"][: len(columns)])

    return archives.select("path").mapInArrow(read, schema)


def quarantined(records: DataFrame, folder: str) -> DataFrame:
    """The gaps among records that were read. Where there are any, they are also written to a table in the
    folder, and logged."""
    gaps = records.where("problem is not null").select("path", "start", "end", "problem")
    if n := gaps.count():
        gaps.write.mode("append").parquet(f"{folder}/gaps")
        log.warning("%d gaps in the archives of %s, listed in %s/gaps", n, folder, folder)
    return gaps


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of what was read."""
    page: Callable = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*):\d+>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("bigint")
    return records.where("problem is null").select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    n = max(1, archives.count())
    records = stage(read_archives(archives.repartition(n, "path"), folder))
    quarantined(records, folder)
    return page_records(records)
