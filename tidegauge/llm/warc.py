"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing: every task writes archives of bounded size into the folder, each opened by a warcinfo record. The commit on the
driver writes a manifest of the archives that belong to the result and of record boundaries in them; what a lost or
repeated task left behind is in no manifest and is never read. Records with payloads already stored elsewhere are revisits.

Reading: partitions are planned from the manifests, a few records' boundaries apart; a folder without one, or a single
file, is read file by file. Predicates on record type and on the headers are pushed into the reader, which parses the
header block of each record first: a record that does not match is stepped over by its Content-Length, and payloads
are only read and decoded if the query wants that column. Plain and gzipped archives are read.

Paths are opened by pyarrow's file systems (file, hdfs, s3, gs, abfss), in the tasks and, for planning, on the driver.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull,
    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tidegauge.llm.common import small, table
from tidegauge.plans.registry import Query
from tidegauge.session import ensure_checkpoint_dir, settle

SPLIT_BYTES = 8 << 20  # between planned boundaries
ARCHIVE_BYTES = 1 << 30  # from which on a task opens a further archive
BATCH_BYTES = 4 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {  # columns of the reader and the header each comes from
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, payload_length long, headers map<string,string>, payload binary"
WRITE_SCHEMA = "warc_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_length long, payload binary"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


# --- writing


def _clean(value: str) -> str:
    """A header value on one line: blanks and control characters as percent codes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def record(kind: str, headers: dict[str, str | None], block: bytes, content_type: str) -> bytes:
    """One WARC/1.1 record; headers without a value are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {_clean(v)}" for k, v in headers.items() if v is not None),
             f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def row_record(row: dict) -> bytes:
    """The record of one row of ``WRITE_SCHEMA``; a revisit holds the HTTP header only."""
    revisit = row["warc_type"] == "revisit"
    headers = {
        "WARC-Record-ID": f"<{row['record_id']}>", "WARC-Target-URI": row["target_uri"], "WARC-Date": row["date"],
        "WARC-Payload-Digest": row["payload_digest"] and f"sha1:{row['payload_digest']}",
        "WARC-Refers-To": f"<{row['refers_to']}>" if row["refers_to"] is not None else None, "WARC-Profile": REVISIT if revisit else None,
    }
    payload = b"" if revisit else row["payload"] or b""
    length = row["payload_length"] if revisit else len(payload)
    return record(row["warc_type"], headers, http_head(length or 0) + payload, "application/http; msgtype=response")


@dataclass
class Archives(WriterCommitMessage):
    """What one task wrote: (file name, bytes, record boundaries) of each archive."""

    files: list[tuple[str, int, list[int]]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, archive_bytes: int, split_bytes: int):
        self.path, self.archive_bytes, self.split_bytes = path, archive_bytes, split_bytes
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        store, folder = file_system(self.path)
        store.create_dir(folder, recursive=True)
        files, out, name, size, bounds = [], None, "", 0, []

        def close() -> None:
            if out is not None:
                out.close()
                files.append((name, size, bounds))

        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.archive_bytes:
                    close()
                    name, size, bounds = f"{self.job}-{uuid.uuid4().hex}.warc", 0, []
                    out = store.open_output_stream(f"{folder}/{name}")
                    info = record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Filename": name}, b"format: WARC File Format 1.1\r\n", "application/warc-fields")
                    size += out.write(info)
                if not bounds or size - bounds[-1] >= self.split_bytes:
                    bounds.append(size if bounds else 0)
                size += out.write(row_record(row))
        close()
        return Archives(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = file_system(self.path)
        store.create_dir(folder, recursive=True)
        listed = [f for m in messages if m for f in m.files]
        with store.open_output_stream(f"{folder}/{self.job}.manifest") as out:
            out.write(json.dumps({"archives": listed}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = file_system(self.path)
        for name, _, _ in (f for m in messages if m for f in m.files):
            store.delete_file(f"{folder}/{name}")


# --- reading


@dataclass
class Stretch(InputPartition):
    """Records that start from ``start`` to before ``stop`` of one archive."""

    path: str
    start: int
    stop: int


@dataclass
class Wanted:
    """Pushed-down conditions on header columns: all must hold."""

    equal: dict[str, set] = field(default_factory=dict)
    tests: list[tuple[str, str, str]] = field(default_factory=list)

    def add(self, condition: Filter) -> bool:
        """True if the reader takes the condition over."""
        name = condition.attribute[0] if len(condition.attribute) == 1 else None
        if name not in HEADERS:
            return False
        if isinstance(condition, (EqualTo, EqualNullSafe)) and condition.value is not None:
            values = {condition.value}
        elif isinstance(condition, In):
            values = {v for v in condition.value if v is not None}
        elif isinstance(condition, (StringStartsWith, StringEndsWith, StringContains, IsNotNull)):
            self.tests.append((type(condition).__name__, name, getattr(condition, "value", "")))
            return True
        else:
            return False
        self.equal[name] = self.equal[name] & values if name in self.equal else values
        return True

    def fits(self, row: dict) -> bool:
        if any(row[c] not in values for c, values in self.equal.items()):
            return False
        checks = {"StringStartsWith": str.startswith, "StringEndsWith": str.endswith, "StringContains": str.__contains__, "IsNotNull": lambda v, _: True}
        return all(row[c] is not None and checks[kind](row[c], value) for kind, c, value in self.tests)


def header_row(lines: list[bytes]) -> dict:
    """Columns of a record from its header lines; folded lines continue the one before."""
    pairs: list[list[str]] = []
    for line in lines[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and pairs:
            pairs[-1][1] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            pairs.append([name.strip(), value.strip()])
    by_name = {k.lower(): v for k, v in reversed(pairs)}
    row = {c: by_name.get(h.lower()) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        row[c] = row[c][1:-1] if row[c] and row[c][0] == "<" and row[c][-1] == ">" else row[c]
    return row | {"content_length": int(by_name.get("content-length", 0)), "headers": [(k, v) for k, v in {k: v for k, v in reversed(pairs)}.items()]}


class _Inflated(io.RawIOBase):
    """The bytes of a gzipped archive, member after member."""

    def __init__(self, source):
        self.source, self.left, self.engine = source, b"", zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while True:
            if self.engine.eof:
                self.left, self.engine = self.engine.unused_data or self.left, zlib.decompressobj(31)
            if not self.left and not (data := self.source.read(1 << 16)):
                return 0
            got = self.engine.decompress(self.left or data, len(out))
            self.left = self.engine.unconsumed_tail
            if got:
                out[:len(got)] = got
                return len(got)


class _Block:
    """A record's block, read as far as asked for; ``skip`` steps over the rest."""

    def __init__(self, stream, length: int, seeks: bool):
        self.stream, self.left, self.seeks = stream, length, seeks

    def read(self, most: int) -> bytes:
        data = self.stream.read(min(most, self.left))
        self.left -= len(data)
        return data

    def head(self) -> bytes:
        """Up to and with the empty line behind an HTTP header, line by line."""
        out = b""
        while self.left and (line := self.stream.readline(self.left)):
            self.left -= len(line)
            out += line
            if not line.strip():
                break
        return out

    def skip(self) -> None:
        if self.seeks:
            self.stream.seek(self.left, 1)
        else:
            while self.left and self.read(1 << 16):
                pass
        self.left = 0


def http_length(head: bytes) -> int | None:
    found = re.search(rb"(?mi)^content-length:\s*(\d+)", head)
    return int(found[1]) if found else None


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split_bytes: int):
        self.path, self.schema, self.split_bytes, self.wanted = path, schema, split_bytes, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for condition in filters:
            if not self.wanted.add(condition):
                yield condition

    def partitions(self) -> list[InputPartition]:
        store, path = file_system(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            return [Stretch(path, 0, info.size)]
        found = store.get_file_info(fs.FileSelector(path))
        manifests = [f.path for f in found if f.path.endswith(".manifest")]
        if not manifests:
            return [Stretch(f.path, 0, f.size) for f in found if re.search(r"\.warc(\.gz)?$", f.path)]
        out: list[InputPartition] = []
        for manifest in manifests:
            with store.open_input_stream(manifest) as source:
                archives = json.loads(source.read())["archives"]
            for name, size, bounds in archives:
                kept = bounds[:1]
                for bound in bounds[1:]:
                    if bound - kept[-1] >= self.split_bytes:
                        kept.append(bound)
                out += [Stretch(f"{path}/{name}", a, b) for a, b in zip(kept, [*kept[1:], size])]
        return out

    def records(self, stretch: Stretch) -> Iterator[tuple[dict, _Block]]:
        """(header columns, block) of the records that fit; of the others only the header is read."""
        store, _ = file_system(self.path)
        packed = stretch.path.endswith(".gz")
        with store.open_input_file(stretch.path) as file:
            if packed:
                stream = io.BufferedReader(_Inflated(file), 1 << 16)
            else:
                file.seek(stretch.start)
                stream = io.BufferedReader(_Raw(file), 1 << 16)
            place = stretch.start
            while packed or place < stretch.stop:
                line = stream.readline()
                if not line:
                    return
                place += len(line)
                if not line.strip():
                    continue  # between records
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record at byte {place - len(line)} of {stretch.path}")
                lines = [line]
                while (line := stream.readline()).strip():
                    place += len(line)
                    lines.append(line.rstrip(b"\r\n"))
                place += len(line)
                row = header_row(lines)
                block = _Block(stream, row["content_length"], not packed)
                if self.wanted.fits(row):
                    yield row, block
                block.skip()
                place += row["content_length"]

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive was planned
            return
        names = self.schema.names
        opened = {"payload", "payload_length"} & set(names)
        rows, size = [], 0
        for row, block in self.records(partition):
            if opened:
                http = (row["content_type"] or "").startswith("application/http")
                head = block.head() if http else b""
                told = http_length(head) if row["warc_type"] == "revisit" else block.left
                row["payload_length"] = told
                row["payload"] = block.read(block.left) if "payload" in names else None
                size += len(row["payload"] or b"")
            rows.append(row)
            size += 200
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"content_length": pa.int64(), "payload_length": pa.int64(), "payload": pa.binary(), "headers": pa.map_(pa.string(), pa.string())}
        return pa.record_batch([pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in self.schema.names], self.schema.names)


class _Raw(io.RawIOBase):
    """A random-access file of pyarrow as a raw Python stream."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        return self.file.seek(offset, whence)

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, out) -> int:
        return self.file.readinto(out)


class WarcDataSource(DataSource):
    """Format ``warc``. Options: path; ``splitBytes`` between partitions; ``archiveBytes`` per archive.

    A schema given to the reader picks the columns that are read: without payload and payload_length no block is opened.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def _split_bytes(self) -> int:
        return int(self.options.get("splitBytes", SPLIT_BYTES))

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], schema, self._split_bytes())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], int(self.options.get("archiveBytes", ARCHIVE_BYTES)), self._split_bytes())


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# --- the archive of a table of pages


def base32_of_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of binary ``payload``: 8 characters for each 10 hexadecimal digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """One row of ``WRITE_SCHEMA`` per page (page_id, url, html).

    Of pages with equal payloads of at least ``least`` bytes that with the smallest page_id is the response, the others
    are revisits of it. Payloads are equal if SHA-1, length and a 64-bit hash are. Null html is the empty payload;
    pages without an id are revisits of one that has an id, and responses if none has; rows that share the smallest id
    and the payload are all responses. Other columns are ignored.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    marked = rows.withColumns({"payload_digest": base32_of_sha1(F.col("payload")), "payload_length": F.length("payload").cast("long")})
    key = ["payload_digest", "payload_length", "_check"]
    slim = marked.where(F.col("payload_length") >= least).select("page_id", "payload_digest", "payload_length", F.xxhash64("payload").alias("_check"))
    first = slim.groupBy(*key).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    shared = settle(first)
    # the few payloads that occur again; rows with them carry the id of their response
    return marked.withColumn("_check", F.xxhash64("payload")).join(small(shared), key, "left").select(
        F.when(F.col("first").isNull() | F.col("first").eqNullSafe(F.col("page_id")), "response").otherwise("revisit").alias("warc_type"),
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        "target_uri", F.lit(None).cast("string").alias("date"), "payload_digest",
        F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"),
        "payload_length", "payload",
    )


def write_pages(pages: DataFrame, path: str, least: int = 0, **options: int) -> None:
    """Archive ``page_records``; ``options`` are those of the format."""
    register(pages.sparkSession)
    records = page_records(pages, least)
    slim = records.withColumn("payload", F.when(F.col("warc_type") == "response", F.col("payload")))
    slim.write.format("warc").options(**options).mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per response and revisit of an archive: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are taken from the payload itself, those of a revisit from its headers.
    """
    register(spark)
    columns = "warc_type string, record_id string, payload_digest string, refers_to string, payload_length long, payload binary"
    found = spark.read.format("warc").schema(columns).load(path).where(F.col("warc_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    stored = F.col("warc_type") == "response"
    return found.select(
        number("record_id").alias("page_id"), F.when(stored, F.length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(stored, base32_of_sha1(F.col("payload"))).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/warc/{uuid.uuid4().hex}"
    write_pages(table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, html, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, 1 + 10 * k, 10))::UBIGINT >> (35 - 5 * j)) & 31 AS INT), 1), '' ORDER BY k, j) AS digest
  FROM p, range(4) a(k), range(8) b(j) GROUP BY page_id, html
), f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM d)
SELECT page_id, strlen(html) AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""

QUERIES: dict[str, Query] = {"op13_warc": op13_warc}
ORACLES: dict[str, str] = {"op13_warc": SQL}
