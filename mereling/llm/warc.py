"""WARC as a PySpark data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Reading plans partitions of whole files up to a size, takes over predicates on the record type
and on header fields, reads a record's headers first, and leaves the payload of a record that
no predicate wants undecoded. Archives have one gzip member per record; those that we write
carry the member's size in the gzip header (subfield "sl"), so an unwanted record is stepped
over without inflating it. Other archives, gzipped by record or plain, are read too.

Files are reached through `pyarrow.fs`, by the path's scheme; schemes that only Hadoop knows are mapped.
"""

import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import DataType

from mereling.llm import scratch
from mereling.sources.paths import file_system

SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, content_length long, payload_digest string, payload_bytes long, refers_to string, payload binary"
ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_length", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARTITION, FILE, BATCH = 32 << 20, 256 << 20, 8 << 20
#: Bytes read ahead; and those inflated at a time while the end of the headers is looked for.
AHEAD, HEAD = 256 << 10, 4096


def header(record: dict) -> bytes:
    """The WARC header of a record; control characters and spaces of the URI are percent-encoded."""
    lines = ["WARC/1.1", f"WARC-Type: {record['record_type']}", f"WARC-Record-ID: <{record['record_id']}>", f"WARC-Date: {record['warc_date']}"]
    if record["target_uri"] is not None:
        lines.append("WARC-Target-URI: " + urllib.parse.quote(record["target_uri"], safe="".join(map(chr, range(0x21, 0x7F)))))
    lines.append(f"WARC-Payload-Digest: sha1:{record['payload_digest']}")
    if record["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <{record['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {record['content_length']}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def member(raw: bytes, level: int = 3) -> bytes:
    """A gzip member whose header tells its own size."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    extra = 12
    size = 10 + 2 + extra + len(body) + 8
    return (b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", extra) + b"sl" + struct.pack("<HQ", 8, size)
            + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF))


def parse_head(raw: bytes) -> tuple[dict, int] | None:
    """The fields of a record and where its payload begins; None if `raw` ends before that."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    begin, length = end + 4, int(fields.get("content-length", 0))
    bytes_ = length
    if fields.get("content-type", "").startswith("application/http") and length:
        http = raw.find(b"\r\n\r\n", begin)
        if http < 0:
            return None
        for line in raw[begin:http].split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                bytes_ = int(line.partition(b":")[2])
        length, begin = length - (http + 4 - begin), http + 4
    bare = lambda x: x.strip("<>") if x is not None else None
    digest = fields.get("warc-payload-digest")
    uri = fields.get("warc-target-uri")
    return {
        "record_type": fields.get("warc-type"), "record_id": bare(fields.get("warc-record-id")), "target_uri": uri and urllib.parse.unquote(uri), "warc_date": fields.get("warc-date"),
        "content_length": int(fields.get("content-length", 0)), "payload_digest": digest and digest.partition(":")[2], "payload_bytes": bytes_, "refers_to": bare(fields.get("warc-refers-to")), "_size": length,
    }, begin


class _Stream:
    """Reads ahead in a file, and steps over what isn't wanted."""

    def __init__(self, file):
        self.file, self.data, self.at = file, b"", 0

    def have(self) -> int:
        return len(self.data) - self.at

    def need(self, n: int) -> bool:
        """Whether n more bytes are there, after reading them."""
        parts, have = [self.data[self.at :]], self.have()
        while have < n and (more := self.file.read(max(AHEAD, n - have))):
            parts.append(more)
            have += len(more)
        if len(parts) > 1:
            self.data, self.at = b"".join(parts), 0
        return have >= n

    def peek(self, begin: int, end: int) -> bytes:
        return self.data[self.at + begin : self.at + end]

    def skip(self, n: int) -> None:
        if n > self.have():
            self.file.seek(n - self.have(), 1)
            self.data, self.at = b"", 0
        else:
            self.at += n


def _member(stream: _Stream, wanted, payload: bool) -> tuple[dict, bytes | None] | None:
    """The record of the next gzip member: its fields and payload; None if it isn't wanted. Only what is needed is read, if the member tells its size."""
    stream.need(24)
    told = stream.peek(3, 4)[0] & 4 and stream.peek(12, 14) == b"sl"
    size = struct.unpack("<Q", stream.peek(16, 24))[0] if told else None
    inflate, raw, used, found = zlib.decompressobj(31), b"", 0, None
    while found is None and not inflate.eof:
        if stream.have() <= used and not stream.need(used + (HEAD if size is None else min(HEAD, size - used) or 1)) and stream.have() <= used:
            break
        part = stream.peek(used, used + HEAD)
        raw += inflate.decompress(part)
        used += len(part) - len(inflate.unused_data)
        found = parse_head(raw)
    if found is None:
        raise ValueError("a WARC record without a complete header")
    fields, begin = found
    take = wanted(fields)
    parts = [raw]
    if size is not None and take and payload and not inflate.eof:
        stream.need(size)
        parts.append(inflate.decompress(stream.peek(used, size)))
    while size is None and not inflate.eof:  # the member's end has to be found
        if stream.have() <= used and not stream.need(used + 1):
            break
        part = stream.peek(used, used + AHEAD)
        if take and payload:
            parts.append(inflate.decompress(part))
        else:  # inflated into nothing, a bounded part at a time
            inflate.decompress(part, AHEAD)
            while inflate.unconsumed_tail and not inflate.eof:
                inflate.decompress(inflate.unconsumed_tail, AHEAD)
        used += len(part) - len(inflate.unused_data)
    stream.skip(used if size is None else size)
    return (fields, b"".join(parts)[begin : begin + fields["_size"]]) if take else None


def _plain(stream: _Stream, wanted, payload: bool) -> tuple[dict, bytes | None] | None:
    """The same of a record that isn't compressed."""
    n = HEAD
    while True:
        more = stream.need(n)
        if (found := parse_head(stream.peek(0, n))) is not None:
            break
        if not more:
            raise ValueError("a WARC record without a complete header")
        n *= 2
    fields, begin = found
    body, take = None, wanted(fields)
    if take and payload:
        stream.need(begin + fields["_size"])
        body = stream.peek(begin, begin + fields["_size"])
    stream.skip(begin + fields["_size"])
    return (fields, body) if take else None


def records(file, wanted, payload: bool = True) -> Iterator[dict]:
    """The records of an open archive for which wanted(fields) holds; others stay undecoded."""
    stream = _Stream(file)
    while stream.need(4):
        if stream.peek(0, 2) == b"\r\n":
            stream.skip(2)
            continue
        found = (_member if stream.peek(0, 2) == b"\x1f\x8b" else _plain)(stream, wanted, payload)
        if found:
            fields, body = found
            yield fields | {"payload": body if payload and fields["record_type"] != "revisit" else None}


@dataclass
class _Files(InputPartition):
    paths: list[str]


def _predicate(f):
    """A test of one field for a filter that headers can answer; None: Spark has to test it."""
    if len(f.attribute) != 1 or f.attribute[0] == "payload":
        return None
    name = f.attribute[0]
    value = getattr(f, "value", None)
    tests = {
        EqualTo: lambda x: x is not None and x == value, EqualNullSafe: lambda x: x == value, In: lambda x: x is not None and x in value,
        IsNull: lambda x: x is None, IsNotNull: lambda x: x is not None, StringStartsWith: lambda x: x is not None and x.startswith(value),
        GreaterThan: lambda x: x is not None and x > value, GreaterThanOrEqual: lambda x: x is not None and x >= value,
        LessThan: lambda x: x is not None and x < value, LessThanOrEqual: lambda x: x is not None and x <= value,
    }
    test = tests.get(type(f))
    return test and (lambda fields: test(fields[name]))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if _predicate(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self):
        fs, path = file_system(self.path)
        found = fs.get_file_info(pa.fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "._" and f.base_name.endswith((".warc", ".warc.gz")))
        parts, full = [], PARTITION
        for name, size in files:
            if full + size > PARTITION:
                parts.append(_Files([]))
                full = 0
            parts[-1].paths.append(name)
            full += size
        return parts or [_Files([])]

    def read(self, partition):
        fs, _ = file_system(self.path)
        tests = [_predicate(f) for f in self.filters]
        wanted = lambda fields: all(t(fields) for t in tests)
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for r in records(file, wanted, self.payload):
                    rows.append(r)
                    size += 500 + len(r["payload"] or b"")
                    if size > BATCH:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Tasks write hidden files of their own; the commit gives those of the tasks that count their names."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator):
        fs, path = file_system(self.path)
        fs.create_dir(path)
        done, out, size = [], None, 0
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None or size > FILE:
                    if out:
                        out.close()
                    done.append(f"{path}/.{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(done[-1], compression=None), 0
                revisit = r["record_type"] == "revisit"
                body = b"" if revisit else r["payload"] or b""
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n".encode()
                data = member(header(r | {"content_length": len(http) + len(body)}) + http + body + b"\r\n\r\n")
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return _Written(done)

    def commit(self, messages):
        fs, path = file_system(self.path)
        fs.create_dir(path)
        ours = {p for m in messages if m for p in m.paths}
        for info in fs.get_file_info(pa.fs.FileSelector(path)):
            if self.overwrite and info.is_file and info.path not in ours:
                fs.delete_file(info.path)
        for k, p in enumerate(sorted(ours)):
            folder, _, name = p.rpartition("/")
            fs.move(p, f"{folder}/part-{k:06d}-{name[1:]}")

    def abort(self, messages):
        fs, _ = file_system(self.path)
        for m in messages:
            for p in m.paths if m else []:
                fs.delete_file(p)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known, and let Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One record per row: of equal payloads of at least `min_bytes`, the row with the largest id is
    the response and the others revisit it; smaller ones are all responses.

    Payloads count as equal when their SHA-256 are (SHA-1, their digest in the record, has known
    collisions). A null payload is empty; a null url has no
    target URI; a null id becomes `urn:page:` and is the response only where its payload has no
    other id, in each of its rows. Repeated rows of the response's id are all responses.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload")).withColumns(
        {"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    rows = rows.withColumn("_same", F.when(F.col("payload_bytes") >= min_bytes, F.unhex(F.sha2("payload", 256))))
    groups = rows.where("_same is not null").groupBy("_same").agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = scratch.keep(groups.where("_n > 1").drop("_n"), "warc-groups")
    rows = rows.join(groups, "_same", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("_id"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.url_encode(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn("_id").alias("record_id"), "target_uri", F.lit(date).alias("warc_date"), F.lit(None).cast("long").alias("content_length"),
        "payload_digest", "payload_bytes", F.when(revisit, urn("_first")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"))


def page_id(urn: str, kind: DataType) -> Column:
    """The id in a record's name, null where it had none."""
    return F.nullif(F.url_decode(F.substring_index(urn, ":", -1)), F.lit("")).cast(kind)


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write `pages` to archives at `path` and read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to; size and digest of responses are taken from the payload that was read. Ids
    may be of any type that a string can be cast to; an empty string comes back as null."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    register(spark)
    to_records(pages).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").load(path)
    own = F.col("record_type") == "response"
    return read.select(
        page_id("record_id", kind).alias("page_id"), F.when(own, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", page_id("refers_to", kind).alias("refers_to"))
