"""WARC archives as a PySpark Python data source, for reading and writing.

Reading plans one partition for each group of archive files. Record types and
header predicates are pushed down; each record's headers are parsed first, and
the payload of an unwanted record is not inflated: archives written here carry
the length of each gzip member in the member's own header, so the reader seeks to
the next one. Foreign archives (``.warc``, ``.warc.gz``) are read too, whether each
record is a gzip member of its own or a member holds many; payloads of unwanted
records are then inflated piece by piece and dropped.

Writing is safe to retry: tasks write files of their own, and a manifest that
lists the files of the successful attempts is written at the commit; the reader
takes only those files. Files are opened through ``pyarrow.fs``, so any folder it
knows (``file``, ``hdfs``, ``s3`` ...) works on all executors.

Defined results: an archive that breaks off or is damaged gives all records before
the damage and one row of type ``damaged`` with the file, the offset and nulls
elsewhere, so the loss can be seen; the rest of that file is not read. Records of one
member have its offset. Urls read back as they were, whatever characters they hold:
those with blanks or controls have a header of their own (as JSON) beside
``WARC-Target-URI``. A null payload is empty; a payload of any length is one record;
null urls and ids have no header and read as null; other columns of the table,
whatever their names, are not written; of equal payloads of at least ``MIN_REVISIT`` bytes the one with the
smallest id is the response (all rows with that id are) and a group without ids
has responses only; an empty table gives an empty archive.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from letterworks.llm.columns import whole
from letterworks.session import prepare, scratch, stage, table

SCHEMA = (
    "file string, offset long, record_type string, record_id string, target_uri string, date string, page_id long, "
    "refers_to long, payload_digest string, payload_bytes long, payload binary"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
WRITE_COLUMNS = ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")
MIN_REVISIT = 100
DAMAGED = "damaged"
FILE_BYTES = 128 << 20
HEAD_BYTES = 8192
#: Fixed values of the WARC and gzip formats.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"
MEMBER_LENGTH = b"RL"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record_bytes(page_id, url, payload, digest, record_type, refers_to, date="1970-01-01T00:00:00Z") -> bytes:
    """One record, its HTTP block included; a revisit's block has the HTTP headers only."""
    payload = payload or b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if record_type == "response":
        block += payload
    heads = [
        ("WARC-Type", record_type),
        ("WARC-Record-ID", record_id(page_id) if page_id is not None else f"<urn:sha256:{digest}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        shown = " ".join(url.split())
        heads.append(("WARC-Target-URI", shown))
        if shown != url or not url:
            heads.append(("X-Target-URI", json.dumps(url)))
    if page_id is not None:
        heads.append(("X-Page-Id", str(page_id)))
    if record_type == "revisit":
        heads += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose header holds the member's whole length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = len(GZIP_HEAD) + 2 + 12 + len(body) + 8
    extra = MEMBER_LENGTH + struct.pack("<HQ", 8, size)
    return GZIP_HEAD + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Member:
    """One gzip member at an offset, inflated no further than asked for. ``out`` is what is inflated and not yet passed."""

    def __init__(self, file, offset: int):
        self.file, self.offset, self.out = file, offset, b""
        head = file.read_at(HEAD_BYTES, offset)
        at = 10
        flags = head[3]
        self.length = None
        if flags & 4:
            n = struct.unpack_from("<H", head, at)[0]
            extra, at = head[at + 2 : at + 2 + n], at + 2 + n
            while len(extra) >= 4:
                k = struct.unpack_from("<H", extra, 2)[0]
                if extra[:2] == MEMBER_LENGTH and k == 8:
                    self.length = struct.unpack_from("<Q", extra, 4)[0]
                extra = extra[4 + k :]
        for flag in (8, 16):  # a file name, a comment
            if flags & flag:
                at = head.index(b"\0", at) + 1
        at += 2 if flags & 2 else 0
        self.unpack = zlib.decompressobj(-15)
        self.out = self.unpack.decompress(head[at:], HEAD_BYTES)
        self.next = offset + len(head)

    def until(self, mark: bytes) -> int:
        while (found := self.out.find(mark)) < 0:
            if not self._more(HEAD_BYTES):
                raise ValueError("a record without the end of its headers")
        return found + len(mark)

    def upto(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self._more(max(n - len(self.out), 1)):
                raise ValueError("a record that breaks off")
        return self.out[:n]

    def _more(self, n: int) -> bool:
        if self.unpack.eof:
            return False
        data = self.unpack.unconsumed_tail
        if not data:
            data = self.file.read_at(max(1 << 16, n // 4), self.next)
            self.next += len(data)
            if not data:
                raise ValueError("a member that breaks off")
        self.out += self.unpack.decompress(data, n)
        return True

    def passed(self, n: int) -> int | None:
        """Go behind the record of ``n`` bytes: the offset of the next member, or None if this one holds more records."""
        if self.length:
            if self.offset + self.length > self.file.size():
                raise ValueError("a member that breaks off")
            return self.offset + self.length
        while len(self.out) < n:
            n -= len(self.out)
            self.out = b""
            if not self._more(1 << 20):
                raise ValueError("a record that breaks off")
        self.out = self.out[n:].lstrip(b"\r\n")
        while not self.out and self._more(HEAD_BYTES):
            self.out = self.out.lstrip(b"\r\n")
        return None if self.out else self.next - len(self.unpack.unused_data) + 8


class _Plain:
    """One record of an archive without compression."""

    def __init__(self, file, offset: int):
        self.file, self.offset, self.out = file, offset, b""

    def until(self, mark: bytes) -> int:
        while (found := self.out.find(mark)) < 0:
            data = self.file.read_at(HEAD_BYTES, self.offset + len(self.out))
            if not data:
                raise ValueError("a record without the end of its headers")
            self.out += data
        return found + len(mark)

    def upto(self, n: int) -> bytes:
        if len(self.out) < n:
            self.out += self.file.read_at(n - len(self.out), self.offset + len(self.out))
        return self.out[:n]

    def passed(self, n: int) -> int:
        if self.offset + n > self.file.size():
            raise ValueError("a record that breaks off")
        at = self.offset + n
        return at + 4 if self.file.read_at(4, at) == b"\r\n\r\n" else at


def _heads(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if v}


def _whole_number(text: str | None) -> int | None:
    """A header's number; null for what is none or has more than 64 bits, as other writers may use our headers' names."""
    number = int(text) if text and text.removeprefix("-").isdecimal() and len(text) < 20 else None
    return number if number is None or -(1 << 63) <= number < 1 << 63 else None


def _target(heads: dict[str, str]) -> str | None:
    """The address as it was written, also if it is no valid header value."""
    try:
        exact = json.loads(heads.get("x-target-uri", "null"))
    except ValueError:
        exact = None
    return exact if isinstance(exact, str) else heads.get("warc-target-uri")


def records(file, name: str, payload: bool, wanted) -> Iterator[tuple]:
    """The rows of one archive. ``wanted`` sees a row without its payload and decides before that is inflated."""
    offset, size, record = 0, file.size(), None
    while offset < size:
        try:
            if record is None:
                packed = file.read_at(2, offset) == b"\x1f\x8b"
                record = _Member(file, offset) if packed else _Plain(file, offset)
            found, n = _record(record, name, payload, wanted)
            after = record.passed(n)
        except (ValueError, IndexError, struct.error, zlib.error):
            damaged = dict.fromkeys(COLUMNS) | {"file": name, "offset": offset, "record_type": DAMAGED}
            if wanted(damaged):
                yield tuple(damaged.values())
            return
        if found:
            yield found
        if after is not None:
            offset, record = after, None


def _record(record: _Member | _Plain, name: str, payload: bool, wanted) -> tuple[tuple | None, int]:
    """The row of a record, None if it is not wanted, and the record's bytes."""
    body = record.until(b"\r\n\r\n")
    if not record.out.startswith(b"WARC/"):
        raise ValueError("no record")
    heads = _heads(record.out[:body])
    length = int(heads.get("content-length", 0))
    kind = heads.get("warc-type")
    row = {
        "file": name,
        "offset": record.offset,
        "record_type": kind,
        "record_id": heads.get("warc-record-id"),
        "target_uri": _target(heads),
        "date": heads.get("warc-date"),
        "page_id": _whole_number(heads.get("x-page-id")),
        "refers_to": _whole_number(heads.get("x-refers-to-page")),
        "payload_digest": heads.get("warc-payload-digest", "").removeprefix("sha256:") or None,
        "payload_bytes": None,
        "payload": None,
    }
    if not wanted(row):
        return None, body + length
    http, at = {}, body
    if "application/http" in heads.get("content-type", "") and length:
        inner = record.upto(body + min(length, HEAD_BYTES))[body:].find(b"\r\n\r\n")
        if inner >= 0:
            http, at = _heads(record.out[body : body + inner]), body + inner + 4
    stored = body + length - at
    row["payload_bytes"] = int(http["content-length"]) if http.get("content-length", "").isdigit() else stored
    if payload and kind != "revisit":
        row["payload"] = record.upto(body + length)[at:]
        row["payload_bytes"] = len(row["payload"])
    return tuple(row[c] for c in COLUMNS), body + length


class Files(InputPartition):
    def __init__(self, uris: list[str]):
        super().__init__(uris)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() == "true"
        self.target = int(options.get("partitionBytes", FILE_BYTES))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        """Equality, IN and prefix tests of header columns are decided on the headers; the rest goes back to Spark."""
        heads = {"record_type", "record_id", "target_uri", "date", "page_id", "refers_to", "payload_digest"}
        for f in filters:
            place = getattr(f, "attribute", ())
            column = place[0] if len(place) == 1 else None
            if column in heads and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in heads and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in heads and isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", (f.value,)))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for column, kind, values in self.tests:
            value = row[column]
            if value is None or not (value in values if kind == "in" else value.startswith(values)):
                return False
        return True

    def partitions(self) -> list[Files]:
        files, root = _open(self.path)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        manifests = [x.path for x in found if x.base_name.startswith("_committed-")]
        sizes = {x.base_name: x.size for x in found if x.is_file and x.base_name.endswith((".warc", ".warc.gz"))}
        if manifests:
            listed = set()
            for m in manifests:
                with files.open_input_file(m) as f:
                    listed |= set(json.loads(f.read()))
            sizes = {k: v for k, v in sizes.items() if k in listed}
        groups, left = [], 0
        for name, size in sorted(sizes.items()):
            if not groups or left + size > self.target:
                groups.append([])
                left = 0
            groups[-1].append(name)
            left += size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files):
        files, root = _open(self.path)
        for name in partition.value:
            with files.open_input_file(f"{root}/{name}") as file:
                yield from records(file, name, self.payload, self.wanted)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.file_bytes = int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in WRITE_COLUMNS]
                for i in range(batch.num_rows):
                    if out is None or size > self.file_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = files.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    data = member(record_bytes(*[c[i].as_py() for c in columns]))
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages) -> None:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/_committed-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages) -> None:
        """Files that no manifest lists are never read."""


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives in a folder; see ``SCHEMA``. Filter on header columns to skip payloads."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The rows to write: ``WRITE_COLUMNS``.

    The first page of each digest that occurs twice is found on narrow rows and written, so that Spark can split a
    very common payload in the join; payloads too small to be revisited are spread over all tasks.
    """
    payload = F.encode(whole(F.col(html_col)), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= MIN_REVISIT
    firsts = rows.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1 and first is not null").select(F.col("payload_digest").alias("key"), "first")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    key = F.when(large, F.col("payload_digest")).otherwise(F.hex(F.xxhash64("page_id", "url")))
    out = rows.withColumn("key", key).join(stage(firsts, "warc-firsts"), "key", "left")
    out = out.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    return out.withColumn("refers_to", F.when(again, F.col("first"))).select(*WRITE_COLUMNS)


def write_warc(pages: DataFrame, path: str, **columns: str) -> None:
    """Write a record for each page to archives in a folder."""
    register(pages.sparkSession)
    classify(pages, **columns).write.format("warc").mode("append").save(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and lengths are taken from the payloads as read back; a revisit has only its headers."""
    path = scratch(prepare(spark), "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    back = read_warc(spark, path).where(F.col("record_type").isin("response", "revisit"))
    return back.select(
        "page_id",
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        "target_uri",
    )


OP1_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to, url AS target_uri
FROM p LEFT JOIN f ON p.d = f.d
"""
