"""Web archives as a Spark data source (operator 5).

Writing: one gzip member per record, whose header carries the member's length, as the standard suggests; tasks write
files of their own and a manifest names those that were committed. Reading: files are planned into byte ranges;
equality predicates on the record type and on header fields are pushed down; the headers of a record are inflated first, and the
rest of a record that is not wanted is neither read nor inflated.
"""

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage)

from wavelark.llm.storage import qualified

FIELDS = ("record_type", "record_id", "refers_to", "target_uri", "date", "payload_digest")
SCHEMA = ", ".join(f"{f} string" for f in FIELDS) + ", content_length long, payload_length long, payload binary"
_ARROW = pa.schema([(f, pa.string()) for f in FIELDS] + [
    ("content_length", pa.int64()), ("payload_length", pa.int64()), ("payload", pa.binary())])
# Header names of the archive standard.
_HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To",
            "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"
_MANIFEST = "_committed"
_HEAD = 4096
_BATCH_BYTES = 8 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path; plain paths are local ones (`write_pages` and `read_archive` give theirs in full)."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value).strip()


def record_bytes(row: dict) -> bytes:
    """A response with its payload, or a revisit with the HTTP header only; both tell the payload's length and digest."""
    revisit = row["refers_to"] is not None
    payload = row["payload"] or b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row['date']}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_one_line(row['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if revisit:
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose extra field `sl` holds its packed and unpacked lengths."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra = b"sl" + struct.pack("<HII", 8, 24 + len(body) + 8, len(data))
    return _MAGIC + b"\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack(
        "<II", zlib.crc32(data), len(data))


class _Message(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        files, out = [], None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or out.tell() >= self.file_bytes:
                    if out is not None:
                        out.close()
                    files.append(f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz")
                    out = store.open_output_stream(f"{root}/{files[-1]}", compression=None)
                out.write(member(record_bytes(row)))
        if out is not None:
            out.close()
        return _Message(files)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{_MANIFEST}-{uuid.uuid4().hex}") as out:
            out.write("".join(f"{f}\n" for m in messages if m for f in m.files).encode())

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        store, root = opened(self.path)
        for m in messages:
            for f in m.files if m else []:
                store.delete_file(f"{root}/{f}")


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def _parsed(head: bytes) -> tuple[dict, int]:
    """Header fields of a record and the place where its block begins."""
    stop = head.index(b"\r\n\r\n") + 4
    values = {}
    for line in head[:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        values[name.strip().lower()] = value.strip()
    row = {f: values.get(h.lower()) for f, h in _HEADERS.items()}
    for f in ("record_id", "refers_to"):
        row[f] = row[f] and row[f].strip("<>")
    row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
    row["content_length"] = int(values.get("content-length") or 0)
    return row, stop


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, payload: bool):
        self.path, self.split_bytes, self.payload = path, split_bytes, payload
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        """Takes over equality and membership of header fields, and leaves the rest to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = opened(self.path)
        infos = [i for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file]
        lists = [i.path for i in infos if i.base_name.startswith(_MANIFEST)]
        named: set[str] = set()
        for path in lists:
            with store.open_input_stream(path) as f:
                named.update(f.read().decode().split())
        files = [i for i in infos if re.search(r"\.warc(\.gz)?$", i.base_name) and (not lists or i.base_name in named)]
        ranges = [_Range(i.path, at, min(at + self.split_bytes, i.size)) for i in sorted(files, key=lambda i: i.path)
                  for at in range(0, i.size, self.split_bytes)]
        return ranges or [_Range("", 0, 0)]

    def _accepts(self, row: dict) -> bool:
        return all(row[name] in values for name, values in self.wanted.items())

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        if partition.path:
            store, _ = opened(self.path)
            with store.open_input_file(partition.path) as f:
                records = _packed_records if partition.path.endswith(".gz") else _plain_records
                for row, block in records(f, partition.begin, partition.end, self._accepts):
                    row["payload"], row["payload_length"] = None, None
                    head = block(_HEAD)
                    cut = head.find(b"\r\n\r\n")
                    if cut >= 0:
                        told = re.search(rb"(?im)^content-length:\s*(\d+)", head[:cut + 2])
                        row["payload_length"] = int(told[1]) if told else row["content_length"] - cut - 4
                        if self.payload and row["record_type"] != "revisit":
                            row["payload"] = block(row["content_length"])[cut + 4:]
                            size += len(row["payload"])
                    rows.append(row)
                    if size >= _BATCH_BYTES or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _packed_records(f, begin: int, end: int, accepts) -> Iterator[tuple]:
    """Records of gzip members that begin in a range; `block(n)` inflates up to n bytes of the block."""
    at = _next_member(f, begin, end) if begin else 0
    size = f.size()
    while at is not None and at < min(end, size):
        f.seek(at)
        start = f.read(24)
        known = struct.unpack("<I", start[16:20])[0] if start[3:4] == b"\x04" and start[12:14] == b"sl" and len(start) == 24 else None
        f.seek(at)
        inflate, raw, data = zlib.decompressobj(31), 0, b""

        def more(wanted: int) -> None:
            nonlocal data, raw
            while len(data) < wanted and not inflate.eof:
                fresh = inflate.unconsumed_tail or f.read(min(1 << 16, known - raw) if known else 1 << 16)
                if not inflate.unconsumed_tail:
                    raw += len(fresh)
                if not fresh:
                    raise EOFError("an archive ends within a record")
                data += inflate.decompress(fresh, max(1, wanted - len(data)))

        while b"\r\n\r\n" not in data and not inflate.eof:
            more(len(data) + _HEAD)
        row, stop = _parsed(data)
        if accepts(row):
            def block(n: int, stop=stop, row=row) -> bytes:
                n = min(n, row["content_length"])
                more(stop + n)
                return data[stop:stop + n]
            yield row, block
        if known:
            at += known
            continue
        while not inflate.eof:  # a foreign member: its end shows only when it is inflated
            data = b""
            more(1 << 20)
        at = at + raw - len(inflate.unused_data)


def _next_member(f, begin: int, end: int) -> int | None:
    """The first member at or after `begin`: the magic bytes, and a record behind them."""
    step = 1 << 20
    for base in range(begin, end, step):
        f.seek(base)
        chunk = f.read(min(step, end - base) + 2)
        at = chunk.find(_MAGIC)
        while at >= 0 and base + at < end:
            f.seek(base + at)
            try:
                if zlib.decompressobj(31).decompress(f.read(1 << 12), 5) == b"WARC/":
                    return base + at
            except zlib.error:
                pass
            at = chunk.find(_MAGIC, at + 1)
    return None


def _plain_records(f, begin: int, end: int, accepts) -> Iterator[tuple]:
    """Records of an archive without compression that begin in a range."""
    at = begin
    if begin:
        f.seek(begin - 4)
        at = None
        for base in range(begin - 4, end, 1 << 20):
            f.seek(base)
            found = f.read((1 << 20) + 16).find(b"\r\n\r\nWARC/1.")
            if found >= 0:
                at = base + found + 4
                break
    while at is not None and at < min(end, f.size()):
        f.seek(at)
        data = f.read(_HEAD)
        while b"\r\n\r\n" not in data and (fresh := f.read(_HEAD)):
            data += fresh
        row, stop = _parsed(data)
        if accepts(row):
            def block(n: int, place=at + stop, row=row) -> bytes:
                f.seek(place)
                return f.read(min(n, row["content_length"]))
            yield row, block
        at += stop + row["content_length"] + 4


class WarcSource(DataSource):
    """Options: path; payload (true: decode payloads of responses); splitBytes; fileBytes (size at which files roll over)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], int(self.options.get("splitBytes", 128 << 20)), self.options.get("payload", "true") == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], int(self.options.get("fileBytes", 1 << 30)))


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base32 without prefix: 20 bytes are four times ten hexadecimal and eight base32 digits."""
    digest = F.upper(F.sha1(data))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, id_column: str = "page_id", url_column: str = "url",
                html_column: str = "html", date: str = "2024-01-01T00:00:00Z", file_bytes: int = 1 << 30) -> None:
    """Archives `pages`, one record each: of equal payloads of at least `min_bytes`, the smallest id is the response.

    A null html is an empty payload, a null url is left out; repeated rows of the smallest id are all responses; rows
    without an id are responses that nothing refers to. An empty table writes an empty archive. Payloads of any length are
    written whole; other columns are not read. A plain path belongs to Spark's default file system.
    """
    path = qualified(pages.sparkSession, path)
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("target_uri"),
                        F.coalesce(F.encode(html_column, "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload")))
    large = (F.length("payload") >= min_bytes) & F.col("id").isNotNull()
    first = rows.where(large).select("id", "payload_digest").groupBy("payload_digest").agg(F.min("id").alias("first"))
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.expr("uuid()")))
    joined = rows.where(large).join(first, "payload_digest").unionByName(rows.where(~large).withColumn("first", F.col("id")))
    joined.select(
        name.alias("record_id"), F.when(F.col("id") != F.col("first"), F.concat(F.lit("urn:page:"), "first")).alias("refers_to"),
        "target_uri", F.lit(date).alias("date"), "payload_digest", "payload",
    ).write.format("warc").option("fileBytes", file_bytes).mode("append").save(path)


def register(spark: SparkSession) -> None:
    """Makes the format `warc` known to the session, with filters pushed down to it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_archive(spark: SparkSession, path: str, payload: bool = True, split_bytes: int = 128 << 20) -> DataFrame:
    """Records of all archives below `path`; payloads of revisits, and of all records on demand, stay unread."""
    register(spark)
    path = qualified(spark, path)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("splitBytes", split_bytes).load(path)


def payload_digest(data: bytes) -> str:
    """The same digest as `base32_sha1`, of bytes at hand."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()
