"""WARC archives: a writer, and a Python data source that plans, filters and skips.

The writer turns rows into gzip members, one per record, each of which names
its compressed length in an extra header field, so that a reader can step over
it. The data source plans partitions of whole files, takes predicates on the
record type and on header columns down into the scan, inflates a record's
headers first, and inflates the payload only of records that pass and only
where payloads are asked for. Members without the extra field are read too,
by inflating them whole.

Defined results: a null payload is empty; header values lose line breaks; of
records with equal payloads of at least ``least`` bytes that with the largest
``page_id`` is the response, the others revisit it; a null ``page_id`` is
written without that header; header names are read in any case; a compressed
record without a length reaches to its member's end, an uncompressed one is an
error. Repeated rows are written each; rows that share
the largest ``page_id`` are all responses. An empty table gives no archives and
an empty result; other columns are ignored.
"""

from __future__ import annotations

import fnmatch
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from tessera.llm import _work as W

#: Payload bytes from which equal payloads are stored once.
LEAST = 1000
#: Plain bytes a reader inflates at first, for the headers.
HEAD = 4096

SCHEMA = "record_type string, record_id string, target_uri string, page_id long, payload_digest string, payload_length long, refers_to long, headers map<string,string>, payload binary"
#: Columns that are single headers.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "page_id": "X-Page-Id", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length", "refers_to": "X-Refers-To-Page"}
_NUMBERS = {"page_id", "payload_length", "refers_to"}
_ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("refers_to", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def member(plain: bytes, level: int = 1) -> bytes:
    """One gzip member whose extra field ``TL`` holds the member's length."""
    body = zlib.compressobj(level, zlib.DEFLATED, -15)
    deflated = body.compress(plain) + body.flush()
    size = 12 + 12 + len(deflated) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"TL" + struct.pack("<HQ", 8, size)
    return head + deflated + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {' '.join(str(v).split())}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page_record(page_id, url, payload: bytes | None, length: int, digest: str, refers_to) -> bytes:
    name = "unnamed" if page_id is None else str(page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    headers = {"WARC-Record-ID": f"<urn:page:{name}:{digest}>", "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-Id": page_id, "X-Payload-Length": str(length), "Content-Type": "application/http;msgtype=response"}
    if refers_to is None:
        return record("response", headers, http + payload)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return record("revisit", headers | {"WARC-Profile": profile, "WARC-Refers-To": f"<urn:page:{refers_to}:{digest}>", "X-Refers-To-Page": str(refers_to)}, http)


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _roles(raw: DataFrame, least: int) -> DataFrame:
    """The rows with ``refers_to``, the page whose payload a row revisits.

    Only digests are compared. If there are few repeated payloads they are
    broadcast and no payload moves; else rows meet their role by page and
    digest, so that one payload of very many pages is no hot key.
    """
    long = raw.where(F.col("size") >= least)
    heads = W.store(long.groupBy("digest", "size").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").select("digest", "size", "head"), "heads")
    of_head = F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to")
    if W.is_few(heads):
        return raw.join(F.broadcast(heads), ["digest", "size"], "left").select(*raw.columns, of_head)
    again = long.select("page_id", "digest", "size").join(heads.hint("merge"), ["digest", "size"]).select("page_id", "digest", of_head).where("refers_to is not null").distinct()
    again = again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    return raw.join(again.hint("merge"), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select(*raw.columns, "refers_to")


def write(pages: DataFrame, folder: str, least: int = LEAST) -> list[str]:
    """Archive ``pages`` (page_id, url, html) under ``folder``; returns the finished files.

    Files are named by task and attempt, and only those of attempts that
    succeeded are returned, so a lost executor leaves no half-read archive.
    """
    raw = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    raw = raw.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    roles = _roles(raw, least).select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), F.col("size").alias("length"), "digest", "refers_to")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        uri = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, n = None, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "length", "digest", "refers_to"))):
                if out is None:
                    fs, path = _open(uri)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                    out.write(member(record("warcinfo", {"Content-Type": "application/warc-fields"}, b"software: tessera\r\n")))
                out.write(member(_page_record(*(x.as_py() for x in row))))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [uri], "records": [n]}, schema=pa.schema([("file", pa.string()), ("records", pa.int64())]))

    return sorted(r["file"] for r in roles.mapInArrow(put, "file string, records long").collect())  # one row per task


class _File(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class Headers:
    """A record's headers as written, looked up whatever their case."""

    def __init__(self, lines: list[str]):
        self.items = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
        self._by_name = {k.lower(): v for k, v in self.items}

    def get(self, name: str) -> str | None:
        return self._by_name.get(name.lower())


def _header_block(plain: bytes) -> tuple[Headers, int] | None:
    end = plain.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = plain[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return Headers(lines[1:]), end + 4


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = json.loads(options["files"]) if "files" in options else None
        self.path, self.glob = options.get("path"), options.get("pathGlobFilter", "*.warc*")
        self.payloads = options.get("payload", "true").lower() != "false"
        self.wanted: list[tuple[str, frozenset[str]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and IN on header columns are decided from headers alone."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = f.value if isinstance(f, In) else (f.value,)
                self.wanted.append((HEADERS[f.attribute[0]], frozenset(f"sha1:{v}" if f.attribute[0] == "payload_digest" else str(v) for v in values if v is not None)))
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] == "record_type":
                continue
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.files is not None:
            return [_File(u) for u in self.files] or [_File("")]
        scheme = self.path.split(":", 1)[0] + "://" if "://" in self.path else ""
        fs, root = _open(self.path if scheme else f"file://{self.path}")
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        return [_File((scheme or "file://") + i.path) for i in sorted(found, key=lambda i: i.path) if i.is_file and fnmatch.fnmatch(i.base_name, self.glob)] or [_File("")]

    def _passes(self, headers: Headers) -> bool:
        return all(headers.get(k) in values for k, values in self.wanted)

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        fs, path = _open(partition.uri)
        rows, held = [], 0
        with fs.open_input_file(path) as f:
            for headers, payload in _records(f, self._passes, self.payloads):
                values = {c: headers.get(h) for c, h in HEADERS.items()}
                values |= {c: int(values[c]) if values[c] is not None else None for c in _NUMBERS}
                if values["payload_digest"]:
                    values["payload_digest"] = values["payload_digest"].removeprefix("sha1:")
                rows.append(values | {"headers": headers.items, "payload": payload})
                held += len(payload or b"") + 1000
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _records(f, passes, payloads: bool) -> Iterator[tuple[Headers, bytes | None]]:
    """Headers, and payload where wanted, of each record that passes; plain or gzip by first bytes."""
    size, at = f.size(), 0
    while at < size:
        f.seek(at)
        start = f.read(HEAD)
        if start[:2] == b"\x1f\x8b":
            known = struct.unpack("<Q", start[16:24])[0] if start[3] & 4 and start[12:14] == b"TL" else None
            inflate = zlib.decompressobj(31)
            plain, rest = inflate.decompress(start, HEAD), inflate.unconsumed_tail
            while (found := _header_block(plain)) is None:
                more = rest or f.read(HEAD)
                if not more:
                    raise ValueError(f"a record's headers are cut off at byte {at}")
                plain, rest = plain + inflate.decompress(more, HEAD), inflate.unconsumed_tail
            headers, body = found
            good = passes(headers)
            if good and payloads or known is None:
                parts = [plain]
                while not inflate.eof:
                    more = rest or f.read(1 << 16)
                    if not more:
                        raise ValueError(f"a record is cut off at byte {at}")
                    parts.append(inflate.decompress(more))
                    rest = inflate.unconsumed_tail
                plain = b"".join(parts)
                if known is None:
                    known = f.tell() - at - len(inflate.unused_data)
            at += known
            length = headers.get("Content-Length")
            end = len(plain) - 4 * plain.endswith(b"\r\n\r\n") if length is None else body + int(length)
            block = plain[body:end] if good and payloads else None
        else:
            plain = start
            while (found := _header_block(plain)) is None:
                more = f.read(HEAD)
                if not more:
                    raise ValueError(f"a record's headers are cut off at byte {at}")
                plain += more
            headers, body = found
            if headers.get("Content-Length") is None:
                raise ValueError(f"the record at byte {at} of an uncompressed archive has no Content-Length")
            length = int(headers.get("Content-Length"))
            good = passes(headers)
            block = None
            if good and payloads:
                f.seek(at + body)
                block = f.read(length)
            at += body + length + 4
        if good:
            yield headers, _payload(headers, block)


def _payload(headers: Headers, block: bytes | None) -> bytes | None:
    """The block without its HTTP head."""
    if block is None or not (headers.get("Content-Type") or "").startswith("application/http"):
        return block
    return block[block.find(b"\r\n\r\n") + 4 :]


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; options ``payload``, ``files`` (JSON list), ``pathGlobFilter``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def read(spark: SparkSession, files: list[str] | str, payload: bool = True) -> DataFrame:
    """Records of archives: a folder, or a list of files. Turns on the session's filter pushdown for Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    source = spark.read.format("warc").option("payload", str(payload).lower())
    return source.load(files) if isinstance(files, str) else source.option("files", json.dumps(files)).load()


def round_trip(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Archive the pages and describe each from the archives."""
    spark = pages.sparkSession
    files = write(pages, folder or W.new_path(spark, "warc"), least)
    full = read(spark, files).where("record_type = 'response'").select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read(spark, files, payload=False).where("record_type = 'revisit'").select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return full.unionByName(again)


ORACLE_SQL = f"""
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), h AS (
  SELECT payload_digest, max(page_id) AS head FROM d WHERE payload_bytes >= {LEAST} GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM d LEFT JOIN h USING (payload_digest)
"""
