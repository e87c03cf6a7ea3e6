"""WARC archives as a Spark data source named ``warc``.

Reading: partitions are whole files, or the byte ranges that this module's writer notes down for its own
files. Filters on header columns are pushed down; a record's headers are parsed first and the payload of a
record that no one wants (its filter fails, or the schema has no payload) is stepped over. Records that are
gzip members carry their compressed length in the 'sl' extra field when written here, so that even
inflating is spared; members without it are inflated to find their end. Pass a schema to read fewer columns.

Writing: every task writes one file of one gzip member per record, under a name of its own attempt. The
files count once the job's manifest names them, so that retried and lost tasks leave nothing behind that a
reader would see. Paths are opened through Arrow's file systems, whose store all executors must share.

Defined cases: null payloads are empty; null headers are left out and read as null; an empty table makes an
archive without records; a truncated last record ends its file with an error; unknown headers are ignored. Rows that
repeat a page's id and payload are records of their own, all responses where that page is the largest of its copies;
a payload is one Python object, of at most 4 GB with its headers; other columns of the pages are not archived.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from strataflow.llm import scratch

SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, "
    "refers_to string, refers_to_uri string, payload_length long, payload binary"
)
#: Fixed by the format: the header of each column.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "refers_to_uri": "warc-refers-to-target-uri",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed by the task: shorter payloads are never revisits.
MIN_REVISIT_BYTES = 1000
#: Bytes of an archive that one read partition takes, and of payload that one batch holds.
SPLIT_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
_TAIL = b"\r\n\r\n"


@dataclass
class Range(InputPartition):
    """A run of records of one file; ``end`` is None for all to its end."""

    path: str
    start: int
    end: int | None


def _open(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names, self.filters = path.rstrip("/"), schema.names, []
        unknown = set(self.names) - set(HEADERS) - {"payload", "payload_length"}
        if unknown:
            raise ValueError(f"warc has no columns {sorted(unknown)}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            known = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)
            if isinstance(f, known) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        store, root = _open(self.path)
        info = store.get_file_info(root)
        if info.type == arrow_fs.FileType.File:
            return [Range(self.path, 0, None)]
        found = store.get_file_info(arrow_fs.FileSelector(root))
        manifests = [x for x in found if x.base_name.startswith("_manifest-")]
        out = []
        for m in manifests:
            with store.open_input_stream(m.path) as f:
                for name, points in json.loads(f.read()):
                    out += [Range(f"{self.path}/{name}", a, b) for a, b in zip(points[:-1], points[1:], strict=True)]
        if not manifests:
            out = [Range(f"{self.path}/{x.base_name}", 0, None) for x in found if x.base_name.endswith((".warc", ".warc.gz"))]
        return out or [Range("", 0, 0)]

    def _wanted(self, headers: dict[str, str | None]) -> bool:
        for f in self.filters:
            v = headers.get(f.attribute[0])
            if isinstance(f, IsNull):
                ok = v is None
            elif isinstance(f, IsNotNull):
                ok = v is not None
            elif isinstance(f, EqualNullSafe):
                ok = v == f.value
            elif v is None:
                ok = False
            elif isinstance(f, EqualTo):
                ok = v == f.value
            elif isinstance(f, In):
                ok = v in f.value
            elif isinstance(f, StringStartsWith):
                ok = v.startswith(f.value)
            elif isinstance(f, StringEndsWith):
                ok = v.endswith(f.value)
            else:
                ok = f.value in v
            if not ok:
                return False
        return True

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kinds = {"payload": pa.binary(), "payload_length": pa.int64()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in self.names])
        rows: list[dict] = []
        held = 0
        if partition.path:
            store, path = _open(partition.path)
            with store.open_input_file(path) as f:
                for row in records(f, partition.start, partition.end, self._wanted, "payload" in self.names):
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 200
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _headers(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in block.split(b"\r\n")[1:]:
        name, sep, value = line.partition(b":")
        if sep:
            out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _columns(h: dict[str, str]) -> dict[str, str | None]:
    out = {c: h.get(k) for c, k in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        if out[c] is not None:
            out[c] = out[c].strip("<>")
    digest = out["payload_digest"]
    if digest is not None and digest.lower().startswith("sha1:"):
        value = digest[5:]
        out["payload_digest"] = base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()
    return out


class _Plain:
    """Records that are not compressed."""

    def __init__(self, f, at: int):
        self.f, self.at, self.buf = f, at, b""
        f.seek(at)

    def head(self) -> bytes | None:
        """The header block at the current place, or None at the end."""
        while (cut := self.buf.find(_TAIL)) < 0:
            more = self.f.read(1 << 16)
            if not more:
                if self.buf.strip():
                    raise ValueError("truncated WARC record")
                return None
            self.buf += more
            self.buf = self.buf.lstrip(b"\r\n") if self.buf[:2] == b"\r\n" else self.buf
        out, self.buf = self.buf[:cut], self.buf[cut + 4 :]
        return out

    def body(self, n: int) -> bytes:
        if len(self.buf) < n:
            self.buf += self.f.read(n - len(self.buf))
        if len(self.buf) < n:
            raise ValueError("truncated WARC record")
        out, self.buf = self.buf[:n], self.buf[n:]
        return out

    def skip(self, n: int) -> None:
        held = min(n, len(self.buf))
        self.buf = self.buf[held:]
        if n > held:
            self.f.seek(self.f.tell() + n - held)

    def end(self) -> int:
        while self.buf[:2] == b"\r\n" or not self.buf:
            self.buf = self.buf.lstrip(b"\r\n")
            if not self.buf:
                self.buf = self.f.read(1 << 12)
                if not self.buf:
                    break
        return self.f.tell() - len(self.buf)


class _Member(_Plain):
    """One gzip member, inflated as far as it is asked for."""

    class _Stream:
        def __init__(self, f, start: int):
            self.f, self.z = f, zlib.decompressobj(31)
            f.seek(start)

        def read(self, n: int) -> bytes:
            out = b""
            while len(out) < n and not self.z.eof:
                raw = self.z.unconsumed_tail or self.f.read(1 << 15)
                if not raw:
                    raise ValueError("truncated gzip member")
                out += self.z.decompress(raw, n - len(out))
            return out

    def __init__(self, f, start: int):
        self.f, self.buf = self._Stream(f, start), b""

    def finish(self) -> int:
        """The place after this member, found by inflating the rest."""
        s = self.f
        while not s.z.eof:
            s.read(1 << 16)
        return s.f.tell() - len(s.z.unused_data)


def _member_length(f, at: int) -> int | None:
    """The compressed length from the 'sl' field of a member written here; 0 at the end of the file."""
    f.seek(at)
    head = f.read(24)
    if not head:
        return 0
    if len(head) == 24 and head[3] & 4 and head[12:16] == b"sl\x08\x00":
        return struct.unpack("<I", head[16:20])[0]
    return None


def records(f, start: int, end: int | None, wanted, with_payload: bool) -> Iterator[dict]:
    """The records of an open file that begin in [start, end), as columns; payloads only of wanted ones."""
    f.seek(start)
    packed = f.read(2) == b"\x1f\x8b"
    at, plain = start, None if packed else _Plain(f, start)
    while end is None or at < end:
        if packed:
            length = _member_length(f, at)
            if length == 0:
                return
            src = _Member(f, at)
        else:
            src = plain
        block = src.head()
        if block is None:
            return
        h = _headers(block)
        size = int(h.get("content-length", 0))
        row: dict = _columns(h)
        if wanted(row):
            http = h.get("content-type", "").startswith("application/http")
            if with_payload:
                body = src.body(size)
                cut = body.find(_TAIL) + 4 if http else 0
                payload, head = body[cut:], body[:cut]
            else:
                head = src.body(min(size, 4096)) if http else b""
                src.skip(size - len(head)) if not packed else None
                cut = head.find(_TAIL) + 4 if http else 0
                head, payload = head[:cut], b""
            stated = _headers(b"\r\n" + head).get("content-length") if http else None
            row["payload_length"] = int(stated) if stated is not None else size - cut
            row["payload"] = payload
            yield row
        elif not packed:
            src.skip(size)
        at = (at + length if length else src.finish()) if packed else src.end()


def record_bytes(row: dict) -> bytes:
    """One record as a gzip member that states its own length."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    body = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row['warc_date']}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {row['target_uri']}")
    if row["payload_digest"] is not None:
        lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['payload_digest'])).decode()}")
    if revisit:
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    if row["refers_to"] is not None:
        lines.append(f"WARC-Refers-To: <{row['refers_to']}>")
    if row["refers_to_uri"] is not None:
        lines.append(f"WARC-Refers-To-Target-URI: {row['refers_to_uri']}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    clean = [x.replace("\r", "%0D").replace("\n", "%0A") for x in lines]
    raw = "\r\n".join(clean).encode() + _TAIL + body + _TAIL
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = z.compress(raw) + z.flush()
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, 24 + len(data) + 8, len(raw))
    return head + data + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    points: list[int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        name, points, at, out = f"part-{uuid.uuid4().hex}.warc.gz", [0], 0, None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                    data = record_bytes(row)
                    out.write(data)
                    at += len(data)
                    if at - points[-1] >= SPLIT_BYTES:
                        points.append(at)
        finally:
            if out is not None:
                out.close()
        if points[-1] < at:
            points.append(at)
        return Written(name if out is not None else None, points)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        if self.overwrite:
            keep = {m.name for m in messages if m}
            for x in store.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True)):
                if x.base_name not in keep:
                    store.delete_file(x.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([[m.name, m.points] for m in messages if m and m.name]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        for m in messages:
            if m and m.name:
                store.delete_file(f"{root}/{m.name}")


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as records: equal payloads of enough bytes are stored once, by the largest page_id."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("long"))
    long = rows.where(F.col("payload_length") >= MIN_REVISIT_BYTES)
    top = long.groupBy("payload_digest", "payload_length").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count(F.lit(1)).alias("n"))
    top = top.where("n > 1").select(F.col("payload_digest").alias("_digest"), F.col("payload_length").alias("_length"), "top")
    top = scratch.write(top, "warc-copies")
    rows = rows.join(top, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_length") == F.col("_length")), "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top.page_id"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("warc_date"),
        "payload_digest",
        F.when(revisit, urn(F.col("top.page_id"))).alias("refers_to"),
        F.when(revisit, F.col("top.url")).alias("refers_to_uri"),
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, path: str) -> None:
    """Archive pages (page_id, url, html) below ``path``."""
    register(pages.sparkSession)
    with_revisits(pages).write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    spark = pages.sparkSession
    path = scratch.new_dir(spark, "warc")
    write(pages, path)
    back = spark.read.format("warc").load(path)
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1)
    page = lambda c: F.when(number(c) != "", number(c).cast("long"))
    response = F.col("record_type") == "response"
    return back.select(
        page(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
        F.col("target_uri").alias("url"),
    )


ORACLE = """
WITH p AS (SELECT page_id, url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT payload_digest, payload_bytes, max(page_id) AS top, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN t.n > 1 AND p.page_id IS DISTINCT FROM t.top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN t.n > 1 AND p.page_id IS DISTINCT FROM t.top THEN t.top END AS refers_to, p.url
FROM p LEFT JOIN t USING (payload_digest, payload_bytes)
"""
