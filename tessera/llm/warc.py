"""WARC archives: a Python data source that reads and writes them, and deduplication into revisit records.

Reading plans one partition for each file. Filters on the record type and on headers are pushed
into the scan: a record's headers are parsed first, and the payload of a record that a filter
rejects, or whose payload the schema doesn't ask for, is skipped. Members of compressed archives
carry their length in the gzip header (the `sl` field of the WARC standard's annex), so a skipped
one is not inflated beyond its headers; members without it are inflated to find their end.

Writing gives each task files of a bounded size under temporary names, and the commit of the job
renames those of the attempts that count.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from . import exchange as X

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, content_type string, content_length long, file string, offset long, payload binary"
#: Column and the header that holds it.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "payload_length": "x-payload-length", "content_type": "content-type", "content_length": "content-length"}
_NAMES = {"warc-record-id": "WARC-Record-ID", "warc-type": "WARC-Type", "warc-target-uri": "WARC-Target-URI", "warc-date": "WARC-Date", "warc-refers-to": "WARC-Refers-To", "warc-payload-digest": "WARC-Payload-Digest", "x-payload-length": "X-Payload-Length", "content-type": "Content-Type", "content-length": "Content-Length"}
_NUMBERS = {"payload_length", "content_length", "offset"}
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: Bytes of an archive after which a task begins another.
FILE_BYTES = 64 << 20
#: Bytes of payloads in a batch that a reader returns.
BATCH_BYTES = 8 << 20


def _fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


# Records


def _clean(value: object) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record(fields: dict[str, object], payload: bytes | None) -> bytes:
    """A record: WARC headers, an HTTP header, and for a response its payload."""
    http = _HTTP + (f"Content-Length: {len(payload)}\r\n\r\n".encode() if payload is not None else b"\r\n")
    block = http + (payload or b"")
    fields = {k: v for k, v in fields.items() if v is not None and k in HEADERS} | {"content_type": "application/http; msgtype=response", "content_length": len(block)}
    lines = [f"{_NAMES[HEADERS[k]]}: {_clean(v)}" for k, v in fields.items()]
    if fields.get("record_type") == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member that says how long it is."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out, last = {}, None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _payload(block: bytes, headers: dict[str, str]) -> bytes | None:
    if headers.get("warc-type") == "revisit":
        return None
    if headers.get("content-type", "").startswith("application/http"):
        at = block.find(b"\r\n\r\n")
        return block[at + 4 :] if at >= 0 else b""
    return block


class _Plain:
    """Records of an archive that isn't compressed; what isn't wanted is skipped by seeking."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.held, self.at = stream, size, b"", 0

    def _fill(self, n: int) -> None:
        while len(self.held) < n and (more := self.stream.read(max(1 << 16, n - len(self.held)))):
            self.held += more

    def __iter__(self):
        while True:
            self._fill(4)
            while self.held.startswith(b"\r\n"):
                self.held, self.at = self.held[2:], self.at + 2
                self._fill(4)
            if not self.held:
                return
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                n = len(self.held)
                self._fill(n + 1)
                if len(self.held) == n:
                    raise ValueError(f"the record at {self.at} has no end of headers")
            headers = _parse(self.held[:end])
            begin, length = end + 4, int(headers.get("content-length", 0))

            def body(begin=begin, length=length) -> bytes:
                self._fill(begin + length)
                return self.held[begin : begin + length]

            yield self.at, headers, body
            self.at += begin + length
            if len(self.held) >= begin + length:
                self.held = self.held[begin + length :]
            else:
                self.held = b""
                self.stream.seek(self.at)


class _Zipped:
    """Records of an archive with one gzip member for each; members that give their length are skipped unread."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.at = stream, size, 0

    def __iter__(self):
        while self.at < self.size:
            self.stream.seek(self.at)
            raw = self.stream.read(1 << 13)
            known = 0
            if raw[:4] == b"\x1f\x8b\x08\x04" and raw[12:14] == b"sl":
                known = struct.unpack("<I", raw[16:20])[0]
            inflate = zlib.decompressobj(31)
            data = inflate.decompress(raw, 1 << 12)
            while (end := data.find(b"\r\n\r\n")) < 0:
                n = len(data)
                data += inflate.decompress(inflate.unconsumed_tail, 1 << 12) or inflate.decompress(self.stream.read(1 << 13), 1 << 12)
                if len(data) == n and inflate.eof:
                    raise ValueError(f"the record at {self.at} has no end of headers")
            headers, length = _parse(data[:end]), 0
            whole: list[bytes] = []

            def finish(data=data, known=known, raw=raw, inflate=inflate, whole=whole) -> bytes:
                if not whole:
                    parts = [data, inflate.decompress(inflate.unconsumed_tail)]
                    if known > len(raw) and not inflate.eof:
                        parts.append(inflate.decompress(self.stream.read(known - len(raw))))
                    while not inflate.eof and (more := self.stream.read(1 << 16)):
                        parts.append(inflate.decompress(more))
                    whole.append(b"".join(parts))
                return whole[0]

            def body(end=end, headers=headers, finish=finish) -> bytes:
                return finish()[end + 4 : end + 4 + int(headers.get("content-length", 0))]

            yield self.at, headers, body
            if known:
                length = known
            else:
                finish()
                length = self.stream.tell() - self.at - len(inflate.unused_data)
            self.at += length


# The data source


@dataclass
class FilePart(D.InputPartition):
    path: str
    size: int


class WarcReader(D.DataSourceReader):
    def __init__(self, schema, options):
        self.columns = [f.name for f in schema.fields]
        self.path = options["path"]
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            kinds = {D.EqualTo: "=", D.In: "in", D.IsNotNull: "some", D.IsNull: "none", D.StringStartsWith: "starts"}
            if name in HEADERS and name not in _NUMBERS and type(f) in kinds:
                self.filters.append((name, kinds[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        fs, path = _fs(self.path)
        info = fs.get_file_info(path)
        found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and re.search(r"\.warc(\.gz)?$", f.path) and f.size)
        return [FilePart(p, n) for p, n in files]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.filters:
            own = headers.get(HEADERS[name])
            if kind == "none":
                ok = own is None
            else:
                ok = own is not None and (kind == "some" or kind == "=" and own == value or kind == "in" and own in value or kind == "starts" and own.startswith(value))
            if not ok:
                return False
        return True

    def read(self, partition: FilePart | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, _ = _fs(self.path)
        kinds = {"payload": pa.binary()} | dict.fromkeys(_NUMBERS, pa.int64())
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.columns])
        rows, size = [], 0
        with fs.open_input_file(partition.path) as stream:
            for at, headers, body in (_Zipped if partition.path.endswith(".gz") else _Plain)(stream, partition.size):
                if not self._wanted(headers):
                    continue
                row = []
                for c in self.columns:
                    if c == "payload":
                        row.append(_payload(body(), headers))
                        size += len(row[-1] or b"")
                    elif c in ("file", "offset"):
                        row.append(partition.path if c == "file" else at)
                    else:
                        value = headers.get(HEADERS[c])
                        row.append(int(value) if value is not None and c in _NUMBERS else value)
                rows.append(row)
                if size >= BATCH_BYTES or len(rows) >= 8192:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Written(D.WriterCommitMessage):
    files: list[str]


class WarcWriter(D.DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.level = int(options.get("level", "1"))
        self.zipped = options.get("compression", "gzip") == "gzip"
        self.ending = ".warc.gz" if self.zipped else ".warc"
        self.old: list[str] = []
        if overwrite:
            fs, path = _fs(self.path)
            self.old = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True)) if re.search(r"\.warc(\.gz)?$", f.path)]

    def write(self, iterator) -> Written:
        fs, path = _fs(self.path)
        fs.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            names = [n for n in batch.schema.names if n != "payload"]
            columns = [batch.column(n).to_pylist() for n in names]
            payloads = batch.column("payload") if "payload" in batch.schema.names else None
            for i in range(batch.num_rows):
                data = record({n: c[i] for n, c in zip(names, columns, strict=True)}, payloads[i].as_py() if payloads is not None else None)
                data = member(data, self.level) if self.zipped else data
                if out is None or size + len(data) > FILE_BYTES:
                    if out:
                        out.close()
                    files.append(f"{path}/{uuid.uuid4().hex}{self.ending}.part")
                    out, size = fs.open_output_stream(files[-1]), 0
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, _ = _fs(self.path)
        for m in messages:
            for f in m.files if m else []:
                fs.move(f, f.removesuffix(".part"))
        for f in self.old:
            fs.delete_file(f)

    def abort(self, messages) -> None:
        fs, _ = _fs(self.path)
        for m in messages:
            for f in m.files if m else []:
                fs.delete_file(f)


class WarcSource(D.DataSource):
    """`format("warc")`. Options: path; for writing compression (gzip or none) and level."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# Deduplication


#: Pages that revisit others, of some 60 bytes each, up to which they are broadcast.
MOST_BROADCAST = 400_000
#: Groups among which pages without an id are dealt.
SALTS = 32


def revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type and refers_to to pages (page_id, url, html).

    Of rows with equal payloads of at least `least_bytes` bytes the one with the smallest page_id is a response, the others
    revisit it; all other rows are responses. A null html is an empty payload. Rows that repeat page_id and payload are the
    same response. A null page_id comes after all others; where all of a group are null, all are responses. Only ids and
    digests are grouped. Up to MOST_BROADCAST pages that revisit are sent to all tasks, and payloads stay where they are;
    beyond, payloads are shuffled once, by page_id (those without one dealt over SALTS), so that a payload of many pages
    doesn't meet in one task.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload_text"), F.sha2(body.cast("binary"), 256).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    large = sized.where(F.col("payload_bytes") >= least_bytes).select("page_id", "payload_digest")
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = large.distinct().join(first, "payload_digest").where(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    later = X.cut(later.select(F.col("page_id").alias("later_id"), F.unhex("payload_digest").alias("later_digest"), F.col("first_id").alias("refers_to")))
    met = F.col("page_id").eqNullSafe(F.col("later_id")) & (F.unhex("payload_digest") == F.col("later_digest"))
    if later.count() <= MOST_BROADCAST:
        out = sized.join(F.broadcast(later), met, "left")
    else:
        none = F.col("page_id").isNull()
        salted = sized.withColumn("salt", F.when(none, F.monotonically_increasing_id() % SALTS).otherwise(0))
        later = later.withColumn("later_salt", F.explode(F.when(F.col("later_id").isNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        out = salted.join(later, met & (F.col("salt") == F.col("later_salt")), "left")
    return out.select("page_id", "url", "payload_text", "payload_bytes", "payload_digest", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")


def write_pages(pages: DataFrame, path: str, least_bytes: int = 100) -> None:
    """Writes a record for every page into archives under `path`."""
    register(pages.sparkSession)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    rows = revisits(pages, least_bytes).select(
        "record_type",
        urn("page_id").alias("record_id"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.col("url").alias("target_uri"),
        F.when(F.col("record_type") == "revisit", urn("refers_to")).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.col("payload_digest")).alias("payload_digest"),
        F.col("payload_bytes").alias("payload_length"),
        F.when(F.col("record_type") == "response", F.col("payload_text").cast("binary")).alias("payload"),
    )
    rows.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Rows page_id, payload_bytes, payload_digest, record_type, refers_to of the archives under `path`.

    Length and digest of a response are those of the payload as read; those of a revisit are in its headers.
    """
    register(spark)
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, 'urn:page:(-?[0-9]*)', 1), '') AS bigint)")
    rows = spark.read.format("warc").schema("record_id string, record_type string, refers_to string, payload_digest string, payload_length long, payload binary").load(path)
    full = F.col("record_type") == "response"
    return rows.where("record_type in ('response', 'revisit')").select(
        number("record_id").alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.expr("substring(payload_digest, 8)")).alias("payload_digest"),
        "record_type",
        F.when(~full, number("refers_to")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Writes the pages into archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{X.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(pages, path, least_bytes)
    return read_pages(spark, path)


def digest(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()
