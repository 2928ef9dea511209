"""WARC as a PySpark Python data source, and a deduplicating writer.

Reading: the driver lists the archives and packs whole files into partitions. Predicates on the record
type and on header columns are taken over by the reader: it parses a record's headers first, and only
decodes the payload of a record that passes. In .warc.gz files every record is a gzip member; a member
with an `sl` extra field (skip length) is jumped over, another is decompressed in pieces and dropped.
Uncompressed archives are jumped by Content-Length. Option payload=false decodes no payload at all.

Writing: each task writes archives of about `maxFileBytes` under names that hold the attempt, and each
commit adds a manifest of its own that lists the finished ones. What a lost or repeated attempt wrote is in no
manifest, so readers never see it. Mode "append" adds to what earlier commits listed; "overwrite" names the manifests that the
new one replaces, and readers pass over those. Paths are URIs that pyarrow.fs opens (file, hdfs, s3, gs). A response's block is an HTTP message, a
head and the payload; a revisit's is the head alone. Digests and sizes are those of the payload.

Cases: null payloads count as empty; of equal payloads (also empty ones) the largest id is the response, the others are
revisits; payloads under `min_bytes` are all responses; rows with a null id are kept, each as a
response; repeated rows of one id and payload are all responses where that id is the largest; an empty table gives an archive folder without records;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from strandlake.llm.shared import new_folder

#: Manifests are MANIFEST followed by the commit's name and .json: {"files": [...], "replaces": [names of manifests]}.
MANIFEST = "_manifest-"
FILE_BYTES = 64 << 20
PARTITION_BYTES, LEAST_PARTITION_BYTES = 128 << 20, 1 << 20
SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, content_length long, headers map<string,string>, payload binary"
#: Column of the schema by WARC header, lower case.
COLUMNS = {"warc-record-id": "record_id", "warc-type": "record_type", "warc-target-uri": "target_uri", "warc-date": "date", "warc-payload-digest": "payload_digest", "warc-refers-to": "refers_to"}
#: Own header: the full payload's size, which a revisit record doesn't hold.
SIZE_HEADER = "X-Payload-Length"
HTTP = "application/http"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def payload_of(block: bytes, content_type: str | None) -> bytes:
    """What stands behind the head of an HTTP message; other blocks as they are."""
    if (content_type or "").partition(";")[0].strip().lower() != HTTP:
        return block
    return block.partition(b"\r\n\r\n")[2]


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 4) -> bytes:
    """A gzip member whose extra field `sl` has the sizes of the member and of the record."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(record) + c.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            k, v = line.split(":", 1)
            last = k.strip().lower()
            out[last] = v.strip()
    return out


class Archive:
    """Sequential reader of one archive: headers(), then payload() or skip()."""

    def __init__(self, stream, size: int, gz: bool):
        self.f, self.size, self.gz, self.at = stream, size, gz, 0
        self.stats = {"records": 0, "payloads": 0}

    def _raw(self, n: int) -> bytes:
        self.f.seek(self.at)
        return self.f.read(n)

    def headers(self) -> dict[str, str] | None:
        if self.at >= self.size:
            return None
        self.stats["records"] += 1
        self.buf, self.read_at, self.z, self.member = b"", self.at, None, 0
        if self.gz:
            top = self._raw(12)
            if top[:2] != b"\x1f\x8b":
                raise ValueError(f"no gzip member at {self.at}")
            if top[3] & 4:
                n = struct.unpack("<H", top[10:12])[0]
                self.f.seek(self.at + 12)
                extra = self.f.read(n)
                if extra[:2] == b"sl":
                    self.member = struct.unpack("<I", extra[4:8])[0]
            self.z = zlib.decompressobj(31)
        while (end := self.buf.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if not self.buf.strip():
                    self.at = self.size
                    return None
                raise ValueError(f"record at {self.at} has no end of headers")
        got = parse_headers(self.buf[:end])
        self.length, self.body = int(got.get("content-length", 0)), end + 4
        return got

    def _more(self, n: int = 1 << 12) -> bool:
        if self.z is not None and self.z.eof:
            return False
        if self.z is not None and self.z.unconsumed_tail:
            piece = self.z.unconsumed_tail
        else:
            self.f.seek(self.read_at)
            piece = self.f.read(n)
            self.read_at += len(piece)
            if not piece:
                return False
        self.buf += self.z.decompress(piece, max(n, 1 << 14)) if self.z is not None else piece
        return True

    def payload(self) -> bytes:
        self.stats["payloads"] += 1
        pieces, have = [self.buf], len(self.buf)
        while have < self.body + self.length:
            self.buf = b""
            if not self._more(1 << 16):
                raise ValueError(f"record at {self.at} is cut off")
            pieces.append(self.buf)
            have += len(self.buf)
        self.buf = b"".join(pieces)
        out = self.buf[self.body : self.body + self.length]
        self.skip()
        return out

    def skip(self) -> None:
        if not self.gz:
            self.at += self.body + self.length + 4
        elif self.member:
            self.at += self.member
        else:
            while not self.z.eof:
                self.buf = b""
                if not self._more(1 << 16):
                    raise ValueError(f"record at {self.at} is cut off")
            self.at = self.read_at - len(self.z.unused_data)


# ---- data source


@dataclass
class Files(InputPartition):
    uris: tuple[str, ...] = ()

    def __init__(self, uris):
        super().__init__(tuple(uris))
        self.uris = tuple(uris)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        self.with_payload = str(options.get("payload", "true")).lower() != "false"
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.parallelism = int(options.get("parallelism", 1))
        self.filters: list[Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if taken(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        files, root = filesystem(self.path)
        info = files.get_file_info(root)
        if info.type == fs.FileType.File:
            found = [info]
        elif commits := manifests(files, root):
            found = files.get_file_info([f"{root}/{n}" for c in commits.values() for n in c["files"]])
        else:
            found = [x for x in files.get_file_info(fs.FileSelector(root, recursive=True)) if x.path.endswith((".warc", ".warc.gz"))]
        out, now, size = [], [], 0
        # whole files can't be split; small ones are packed, but not into fewer tasks than there are cores
        most = min(self.partition_bytes, max(LEAST_PARTITION_BYTES, sum(x.size for x in found) // max(self.parallelism, 1)))
        for x in sorted(found, key=lambda x: x.path):
            if now and size + x.size > most:
                out.append(Files(now))
                now, size = [], 0
            now.append(x.path)
            size += x.size
        return [*out, Files(now)] if now or not out else out

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(self.path)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.string()] * 6 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        rows: list[tuple] = []
        size = 0

        def flush():
            cols = list(zip(*rows)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for path in partition.uris:
            info = files.get_file_info(path)
            with files.open_input_file(path) as f:
                archive = Archive(f, info.size, path.endswith(".gz"))
                while (h := archive.headers()) is not None:
                    row = {c: h.get(k) for k, c in COLUMNS.items()} | {"content_length": archive.length}
                    if not all(passes(x, row) for x in self.filters):
                        archive.skip()
                        continue
                    payload = None
                    if self.with_payload:
                        payload = payload_of(archive.payload(), h.get("content-type"))
                        if self.verify and row["record_type"] == "response" and row["payload_digest"] and row["payload_digest"].rpartition(":")[2] != sha1_base32(payload):
                            raise ValueError(f"{row['record_id']}: the payload doesn't match its digest")
                    else:
                        archive.skip()
                    rows.append((*row.values(), list(h.items()), payload))
                    size += len(payload or b"")
                    if len(rows) >= 2048 or size > 8 << 20:
                        yield flush()
                        rows.clear()
                        size = 0
        if rows:
            yield flush()


def manifests(files, root: str) -> dict[str, dict]:
    """The manifests that hold, by name: those that no other one replaces."""
    from pyarrow import fs

    listed = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    found = {}
    for x in listed:
        if x.base_name.startswith(MANIFEST):
            with files.open_input_stream(x.path) as f:
                found[x.base_name] = json.loads(f.read())
    gone = {n for c in found.values() for n in c["replaces"]}
    return {n: c for n, c in sorted(found.items()) if n not in gone}


def _column(f) -> str | None:
    return f.attribute[0] if len(f.attribute) == 1 and f.attribute[0] in {*COLUMNS.values(), "content_length"} else None


_TESTS = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__,
}


def taken(f: Filter) -> bool:
    """Whether the reader applies this predicate."""
    if isinstance(f, Not):
        return taken(f.child)
    return isinstance(f, (IsNull, IsNotNull, EqualNullSafe, *_TESTS)) and _column(f) is not None


def truth(f: Filter, row: dict):
    """SQL's truth of a predicate: True, False or None."""
    if isinstance(f, Not):
        inner = truth(f.child, row)
        return None if inner is None else not inner
    v = row[_column(f)]
    if isinstance(f, IsNull):
        return v is None
    if isinstance(f, IsNotNull):
        return v is not None
    if isinstance(f, EqualNullSafe):
        return v == f.value
    return None if v is None or f.value is None else _TESTS[type(f)](v, f.value)


def passes(f: Filter, row: dict) -> bool:
    return truth(f, row) is True


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Columns: record_id, record_type, target_uri, payload, payload_digest, refers_to, payload_length."""

    def __init__(self, options, overwrite: bool = False):
        self.path, self.overwrite = options.get("path"), overwrite
        self.file_bytes = int(options.get("maxFileBytes", FILE_BYTES))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        attempt, done, out, size = uuid.uuid4().hex, [], None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    if out is None:
                        done.append(f"{attempt}-{len(done):05d}.warc.gz")
                        out, size = files.open_output_stream(f"{root}/{done[-1]}", compression=None), 0
                    h = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", f"{HTTP}; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + r["payload_digest"]), (SIZE_HEADER, str(r["payload_length"]))]
                    if r["target_uri"]:
                        h.append(("WARC-Target-URI", "".join(c for c in r["target_uri"] if c not in "\r\n")))
                    if r["refers_to"]:
                        h += [("WARC-Refers-To", r["refers_to"]), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                    member = gzip_member(record_bytes(h, http_head(r["payload_length"]) + (r["payload"] or b"")))
                    out.write(member)
                    size += len(member)
                    if size >= self.file_bytes:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return Written(done)

    def commit(self, messages) -> None:
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        own = {"files": sorted(n for m in messages if m is not None for n in m.files), "replaces": [*manifests(files, root)] if self.overwrite else []}
        with files.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(own).encode())

    def abort(self, messages) -> None:
        files, root = filesystem(self.path)
        for m in messages:
            for n in m.files if m is not None else ():
                files.delete_file(f"{root}/{n}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---- deduplicating writer


def write_pages(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, mode: str = "append") -> None:
    """Write each page as a response or, where a page of larger id has the same payload, as a revisit of the largest.

    mode: "append" (pages are compared with those of the same call only) or "overwrite". The group of equal payloads is never gathered: the largest id comes from an aggregate with map-side
    partial maxima, and the pages meet it by a join that Spark can split where a digest is frequent.
    """
    register(df.sparkSession)
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    pages = pages.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    newest = pages.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.max("id").alias("keep"))
    rows = pages.join(newest, "sha", "left").withColumn("revisit", F.coalesce((F.col("size") >= min_bytes) & (F.col("id") != F.col("keep")), F.lit(False)))
    digest = base32("sha")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    rows.select(
        urn("id").alias("record_id"), F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.when(~F.col("revisit"), F.col("payload")).alias("payload"), digest.alias("payload_digest"), F.when(F.col("revisit"), urn("keep")).alias("refers_to"), F.col("size").cast("long").alias("payload_length"),
    ).write.format("warc").mode(mode).save(path)


def base32(hex_column: str):
    """Upper-case base32 of a SHA-1 in hex: eight groups of five hex digits are each four base32 digits."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    part = lambda i: F.conv(F.substring(hex_column, 5 * i + 1, 5), 16, 32)
    text = F.concat(*[F.lpad(part(i), 4, "0") for i in range(8)])
    return F.translate(text, "0123456789ABCDEFGHIJKLMNOPQRSTUV", digits)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from the archives."""
    register(spark)
    rows = spark.read.format("warc").option("verify", "true").option("parallelism", spark.sparkContext.defaultParallelism).load(path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    full = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("headers")[SIZE_HEADER.lower()].cast("long"))
    return rows.select(page("record_id").alias("page_id"), full.alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


def archive_round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read those back."""
    path = new_folder(df.sparkSession, "warc")
    write_pages(df, path, id_col, url_col, html_col, min_bytes)
    return read_pages(df.sparkSession, path)
