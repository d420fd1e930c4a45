"""WARC archives as a Spark data source, with deduplicated writing.

``spark.read.format("marginkit_warc").load(folder)`` reads all ``*.warc`` and ``*.warc.gz`` files of a
folder. Partitions are planned from the file list: files are dealt, largest first, over
as many partitions as their bytes need. Equality and IN filters on ``record_type``,
``target_uri`` and ``record_id`` are pushed into the reader. It parses each record's
header first and, if a pushed filter or the ``payload=false`` option rules the payload
out, skips or drops it by its Content-Length without decoding it as text.

``df.write.format("marginkit_warc").mode("append").save(folder)`` writes one gzip member per record, in files of
about ``FILE_BYTES``. Each task writes under a name of its own and the names become
visible only at commit, so retried and speculative tasks leave no duplicates behind.

Files are opened through pyarrow's file systems, so the folder may be local (shared) or
any store pyarrow knows (hdfs, s3, gs, abfs).

Edge cases: a null payload is written as an empty one; payloads are bytes; header values
have line breaks replaced by spaces; an empty table writes no file, and an empty folder
reads as an empty table; a record cut off at the end of a file ends the file with an
error, not silently.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition,
                                    WriterCommitMessage)

from .common import materialise
from ..session import scratch_path

FORMAT = "marginkit_warc"
SCHEMA = ("record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
          "payload_length long, payload binary")
FILE_BYTES = 128 << 20
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
PUSHED = ("record_type", "record_id", "target_uri")
#: header names in the order they are written; the first three columns can be filtered on
_HEADERS = {"WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Target-URI": "target_uri",
            "WARC-Refers-To": "refers_to", "WARC-Payload-Digest": "payload_digest", "X-Payload-Length": "payload_length"}
_ARROW = pa.schema([(n, pa.int64() if n == "payload_length" else pa.binary() if n == "payload" else pa.string())
                    for n in [*_HEADERS.values(), "payload"]])


def _store(path: str):
    """File system and path of a folder named by URI or local path."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def record(row: dict) -> bytes:
    """One record as a gzip member."""
    payload = row["payload"] or b""
    lines = ["WARC/1.1"]
    for header, column in _HEADERS.items():
        value = row[column]
        if value is not None:
            lines.append(f"{header}: " + str(value).replace("\r", " ").replace("\n", " "))
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"Content-Length: {len(payload)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + payload + b"\r\n\r\n", compresslevel=1, mtime=0)


class Members:
    """Uncompressed bytes of a .warc or .warc.gz stream, member by member."""

    def __init__(self, stream, packed: bool):
        self.stream, self.packed = stream, packed
        self.raw, self.out, self.inflate = b"", bytearray(), zlib.decompressobj(31)

    def _fill(self) -> bool:
        data = self.raw or self.stream.read(1 << 18)
        self.raw = b""
        if not data:
            return False
        if not self.packed:
            self.out += data
            return True
        self.out += self.inflate.decompress(data)
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before ``mark``, which is dropped; None at the end."""
        seen = 0
        while (at := self.out.find(mark, seen)) < 0:
            seen = max(0, len(self.out) - len(mark) + 1)
            if not self._fill():
                if bytes(self.out).strip():
                    raise ValueError("archive ends inside a record header")
                return None
        found = bytes(self.out[:at])
        del self.out[:at + len(mark)]
        return found

    def take(self, n: int, keep: bool) -> bytes | None:
        """The next n bytes; if not ``keep`` they are dropped as they come."""
        parts, left = [], n
        while left:
            if not self.out and not self._fill():
                raise ValueError("archive ends inside a record")
            part = self.out[:left]
            del self.out[:left]
            left -= len(part)
            if keep:
                parts.append(bytes(part))
        return b"".join(parts) if keep else None


def records(stream, packed: bool, wanted: dict, payload: bool):
    """Rows of an archive whose header passes ``wanted`` (column -> allowed values)."""
    members = Members(stream, packed)
    while (head := members.until(b"\r\n\r\n")) is not None:
        row = dict.fromkeys(_ARROW.names)
        length = 0
        for line in head.decode("utf-8", "replace").split("\r\n"):
            name, _, value = line.partition(": ")
            if name in _HEADERS:
                row[_HEADERS[name]] = value
            elif name.lower() == "content-length":
                length = int(value)
        passes = all(row[c] in values for c, values in wanted.items())
        body = members.take(length, keep=passes and payload)
        members.take(4, keep=False)
        if passes:
            row["payload"] = body
            row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else length
            yield row


@dataclass
class Files(InputPartition):
    paths: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column in PUSHED and values is not None:
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self):
        store, path = _store(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=False, allow_not_found=True))
        files = sorted(((f.size, f.path) for f in found if f.path.endswith((".warc", ".warc.gz"))), reverse=True)
        bins: list[list] = []
        room = 0
        for size, name in files:
            if not bins or room < size:
                bins.append([])
                room = self.split
            bins[-1].append(name)
            room -= size
        return [Files(b) for b in bins]

    def read(self, partition):
        store, _ = _store(self.path)
        rows, size = [], 0
        for path in partition.paths if partition is not None else []:
            with store.open_input_stream(path, compression=None) as stream:
                for row in records(stream, path.endswith(".gz"), self.wanted, self.payload):
                    rows.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.limit = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator):
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{path}/_{names[-1]}.part", compression=None), 0
                data = record(row)
                out.write(data)
                size += len(data)
                if size >= self.limit:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        for message in messages:
            for name in message.names if message else ():
                store.move(f"{path}/_{name}.part", f"{path}/{name}")

    def abort(self, messages):
        store, path = _store(self.path)
        for message in messages:
            for name in message.names if message else ():
                store.delete_file(f"{path}/_{name}.part")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark) -> None:
    """Register the source and allow filters to be pushed into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def to_records(pages: DataFrame, min_bytes: int = 100, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Records of the pages. Of pages with equal payloads of ``min_bytes`` or more, the one
    with the smallest key is a response, the others are revisits of it without payload.

    A null key is never the first of its group unless all are null, and then all are
    responses. Rows that repeat a key with the same payload are responses each if the key
    is the group's smallest.
    """
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    body = pages.select(F.col(key).cast("long").alias("_key"), F.col(url).alias("_url"), payload.alias("_body"))
    body = body.withColumn("_digest", F.sha2("_body", 256)).withColumn("_length", F.octet_length("_body").cast("long"))
    first = (body.where(F.col("_length") >= min_bytes).groupBy("_digest")
             .agg(F.min("_key").alias("_first"), F.max("_key").alias("_last"), F.count(F.lit(1)).alias("_n"))
             .where("_n > 1"))
    # only groups with copies; plain shuffle sides, so that AQE can split a hot group
    first = materialise(first.select("_digest", "_first"), "warc-copies").withColumnRenamed("_digest", "_d")
    rows = body.join(first, (F.col("_digest") == F.col("_d")) & (F.col("_length") >= min_bytes), "left")
    revisit = F.col("_first").isNotNull() & ((F.col("_key") != F.col("_first")) | F.col("_key").isNull())
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(urn(F.col("_key")), F.lit("<urn:page:null>")).alias("record_id"), F.col("_url").alias("target_uri"),
        F.when(revisit, urn(F.col("_first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "_digest").alias("payload_digest"), F.col("_length").alias("payload_length"),
        F.when(~revisit, F.col("_body")).alias("payload"))


def archive(pages: DataFrame, folder: str | None = None, **names) -> str:
    """Write the pages as archives and return their folder."""
    spark = pages.sparkSession
    register(spark)
    folder = folder or scratch_path(spark, "warc")
    to_records(pages, **names).write.format(FORMAT).mode("append").save(folder)
    return folder


def load(spark, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("payload", str(payload).lower()).load(folder)


def page_records(spark, folder: str) -> DataFrame:
    """Read archives back: responses with their payload measured, revisits by header only."""
    key = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(key(c) != "", key(c)).cast("long")
    full = load(spark, folder).where("record_type = 'response'").select(
        "record_type", "record_id", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"))
    again = load(spark, folder, payload=False).where("record_type = 'revisit'").select(
        "record_type", "record_id", "refers_to", F.col("payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"))
    return full.unionByName(again).select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number(F.col("refers_to")).alias("refers_to"))
