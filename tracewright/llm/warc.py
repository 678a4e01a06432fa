"""WARC archives of web pages: a Spark data source that writes gzip members and reads archives by byte ranges.

``spark.read.format("warc").load(folder)`` deals the archives' bytes into ranges. A task scans its range for the bytes that
begin a gzip member, decodes each such place, and takes it for a record only if it inflates to its end with a right checksum,
starts as a WARC header, holds as many bytes as that header says, and is followed by another member or the file's end. It
owns the records that start inside its range: from the first one it goes on from member to member, past the range's end where
the last one reaches there. Damaged members are passed over, and the scan goes on behind them. (A payload that itself holds
archives, stored unpacked over more than a whole range, would need longer ranges.)

``df.write.format("warc").save(folder)`` writes one member a record under names that no other attempt uses; the list of files
that counts is written last, so a failed or repeated task leaves nothing that readers see.

Of records with equal payloads of at least ``min_bytes`` the one with the smallest page_id (null last; then the smallest url,
null first) is the response, and the others are revisits without a payload, whose HTTP head still states its length. Equal
payloads are those of equal SHA-256. Repeated rows are records of their own: one response, the rest revisits that refer to
their own page_id. Null html is an empty payload, texts of any length are one record each, null urls have no URI. An empty
table gives an archive without records. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tracewright.llm.common import shared_folder, table

MIN_BYTES = 0
#: Bytes of a range, of an archive file before the next one begins, of one read, and of a batch of records.
SPLIT, FILE, READ, BATCH = 16 << 20, 1 << 30, 1 << 20, 8 << 20
MAGIC, LISTED = b"\x1f\x8b\x08", "_archives.json"
#: Archives are the same whenever they are written.
DATE = "2000-01-01T00:00:00Z"
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, intact boolean, file string, offset long"
_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)[ \t]*\r?$", re.M)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def place(folder: str) -> tuple[pafs.FileSystem, str]:
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        return pafs.LocalFileSystem(), url.path
    where, path = pafs.FileSystem.from_uri(folder)
    return where, path


def line(value: str | None) -> str | None:
    """A header value on one line: control characters are percent-encoded."""
    return None if value is None else re.sub(r"[\x00-\x1f\x7f]", lambda m: "%%%02X" % ord(m[0]), value)


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One gzip member that holds one record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode()) + packed.compress(block) + packed.compress(b"\r\n\r\n") + packed.flush()


def page_record(record_id: str, kind: str, uri: str | None, payload: bytes, size: int, digest: str, refers_to: str | None, refers_uri: str | None) -> bytes:
    """A response with its payload, or a revisit without; both state the payload's digest and length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", line(uri)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Refers-To-Target-URI", line(refers_uri))]
    return record([*fields, ("Content-Type", "application/http;msgtype=response")], block)


def fields_of(head: bytes) -> dict[str, str]:
    return {k.decode("latin-1").strip().lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(head)}


def parsed(content: bytes) -> dict | None:
    """The record that a member holds, or None if it holds none."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    fields = fields_of(head)
    length = fields.get("content-length", "")
    if not head.startswith(b"WARC/") or not gap or not length.isdigit() or len(rest) < int(length):
        return None
    payload, stated = rest[: int(length)], None
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = payload.partition(b"\r\n\r\n")
        stated = fields_of(http).get("content-length", "")
    kind, said = fields.get("warc-type"), fields.get("warc-payload-digest", "").rpartition(":")[2].upper() or None
    bare = {k: fields[k].strip("<>") if k in fields else None for k in ("warc-record-id", "warc-refers-to")}
    out = {"record_id": bare["warc-record-id"], "record_type": kind, "target_uri": fields.get("warc-target-uri"), "refers_to": bare["warc-refers-to"]}
    if kind == "revisit":
        return out | {"payload": None, "payload_bytes": int(stated) if stated and stated.isdigit() else None, "payload_digest": said, "intact": None}
    digest = base32_sha1(payload)
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest, "intact": said is None or said == digest}


class Bytes:
    """A file's bytes by place, read in long stretches."""

    def __init__(self, where: pafs.FileSystem, path: str, size: int):
        self.file, self.size, self.start, self.held = where.open_input_file(path), size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        """Up to n bytes from the place on; fewer only where a stretch or the file ends."""
        inside = place - self.start
        if not 0 <= inside < len(self.held):
            self.file.seek(place)
            self.start, self.held, inside = place, self.file.read(min(4 * READ, self.size - place)) if place < self.size else b"", 0
        return self.held[inside : inside + n]

    def exactly(self, place: int, n: int) -> bytes:
        first = self.at(place, n)
        return first + self.at(place + len(first), n - len(first)) if 0 < len(first) < n else first


def member(source: Bytes, start: int) -> tuple[bytes, int] | None:
    """What the gzip member at this place holds, and the place behind it; None if it is none or holds no record."""
    unpack, parts, at, n, seen = zlib.decompressobj(31), [], start, 1 << 14, b""
    try:
        while not unpack.eof:
            chunk = source.at(at, n)
            if not chunk:
                return None
            parts.append(unpack.decompress(chunk))
            at, n = at + len(chunk), READ
            if len(seen) < 5:
                seen = (seen + parts[-1])[:5]
                if not b"WARC/".startswith(seen):
                    return None
    except zlib.error:
        return None
    return b"".join(parts), at - len(unpack.unused_data)


def next_magic(source: Bytes, start: int, end: int) -> int:
    """The first place in [start, end) where a member may begin, else end."""
    while start < end:
        chunk = source.exactly(start, min(READ, end - start + 2))
        found = chunk.find(MAGIC)
        if found >= 0 and start + found < end:
            return start + found
        start += max(1, len(chunk) - 2)
    return end


def records_in(source: Bytes, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """(place, record) of the records that begin in [start, end)."""
    at, known = start, start == 0
    while at < end:
        at_member = source.exactly(at, 3) == MAGIC
        if not at_member:
            at, known = next_magic(source, at, end), False
            continue
        found = member(source, at)
        made = found and parsed(found[0])
        behind = found[1] if found else at
        if not made or not known and behind < source.size and source.exactly(behind, 3) != MAGIC:
            at, known = at + 1, False
            continue
        yield at, made
        at, known = behind, True


@dataclass
class Ranges(InputPartition):
    """What one task reads: (file, from, to, the file's size)."""

    parts: list[tuple[str, int, int, int]]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.split = options["path"], int(options.get("splitbytes", SPLIT))

    def partitions(self) -> list[Ranges]:
        """Ranges of about the split size; small files share a task."""
        where, root = place(self.folder)
        listed = f"{root}/{LISTED}"
        if where.get_file_info(listed).type == pafs.FileType.File:
            with where.open_input_file(listed) as f:
                files = [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
        else:
            infos = where.get_file_info(pafs.FileSelector(root, recursive=True)) if where.get_file_info(root).type == pafs.FileType.Directory else [where.get_file_info(root)]
            files = sorted((i.path, i.size) for i in infos if i.type == pafs.FileType.File and i.path.endswith(".warc.gz"))
        out, parts, held = [], [], 0
        for path, size in files:
            for start in range(0, size, self.split):
                end = min(size, start + self.split)
                if parts and held + end - start > self.split:
                    out.append(Ranges(parts))
                    parts, held = [], 0
                parts.append((path, start, end, size))
                held += end - start
        return [*out, Ranges(parts)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("file", pa.string()), ("offset", pa.int64())])
        where, _ = place(self.folder)
        rows, held = [], 0
        for path, start, end, size in partition.parts:
            for offset, made in records_in(Bytes(where, path, size), start, end):
                rows.append(made | {"file": os.path.basename(path), "offset": offset})
                held += len(made["payload"] or b"") + 500
                if held >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.file, self.overwrite = options["path"], int(options.get("filebytes", FILE)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = place(self.folder)
        where.create_dir(root, recursive=True)
        out, files = None, []
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("record_id", "record_type", "target_uri", "payload", "payload_bytes", "payload_digest", "refers_to", "refers_uri")]
            for values in zip(*columns, strict=True):
                made = [v.as_py() for v in values]
                made[3] = made[3] or b""
                if out is None:
                    name = f"pages-{os.urandom(12).hex()}.warc.gz"
                    out, size = where.open_output_stream(f"{root}/{name}", compression=None), 0
                    size += out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                size += out.write(page_record(*made))
                if size >= self.file:
                    out.close()
                    files, out = [*files, (name, size)], None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def _listed(self) -> list:
        where, root = place(self.folder)
        if self.overwrite or where.get_file_info(f"{root}/{LISTED}").type != pafs.FileType.File:
            return []
        with where.open_input_file(f"{root}/{LISTED}") as f:
            return json.loads(f.read())

    def commit(self, messages: list[Written | None]) -> None:
        where, root = place(self.folder)
        where.create_dir(root, recursive=True)
        files = sorted([*map(tuple, self._listed()), *(f for m in messages if m for f in m.files)])
        with where.open_output_stream(f"{root}/{LISTED}", compression=None) as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        where, root = place(self.folder)
        for name, _ in (f for m in messages if m for f in m.files):
            where.delete_file(f"{root}/{name}")


class Warc(DataSource):
    """Options: splitBytes (of a range, when reading), fileBytes (after which a file ends, when writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def page_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The records to write, in no order: a response for each distinct payload, revisits for its repeats.

    The payloads are dealt by (digest, page_id), so that copies of one payload spread; which one is first is found from ids.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("key", F.sha2("payload", 256))
    # a name in place of a null id: equal keys of join and window let one shuffle serve both
    rows = rows.withColumn("page", F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    ids = rows.groupBy("key", "page").agg(F.min(F.struct("url")).alias("u"), F.min("page_id").alias("page_id"))
    firsts = ids.groupBy("key").agg(F.min(F.struct(F.isnull("page_id").alias("none"), "page_id", "u")).alias("first"))
    decided = ids.join(firsts, "key").select("key", "page", F.col("first.page_id").alias("first_id"), F.col("first.u.url").alias("refers_uri"))
    met = rows.join(decided, ["key", "page"]).withColumn("copy", F.row_number().over(W.partitionBy("key", "page").orderBy("url")))
    named = lambda page_id, copy: F.concat_ws(":", F.lit("urn:page"), F.coalesce(page_id.cast("string"), F.lit("none")), copy.cast("string"), F.substring("key", 1, 16))
    size = F.length("payload")
    response = (size < min_bytes) | (F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("copy") == 1))
    return met.select(
        named(F.col("page_id"), F.col("copy")).alias("record_id"), F.when(response, "response").otherwise("revisit").alias("record_type"), F.col("url").alias("target_uri"), F.when(response, F.col("payload")).alias("payload"), size.cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("sha1"), F.when(~response, named(F.col("first_id"), F.lit(1))).alias("refers_to"), F.when(~response, F.col("refers_uri")).alias("refers_uri"),
    ).withColumn("payload_digest", base32("sha1")).drop("sha1")


def base32(digest: str):
    """A hexadecimal SHA-1 in upper-case base32: five hexadecimal digits are four characters."""
    letters = F.array(*map(F.lit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
    parts = []
    for k in range(1, 41, 5):
        number = F.conv(F.substring(digest, k, 5), 16, 10).cast("int")
        parts += [F.element_at(letters, F.shiftright(number, shift).bitwiseAND(31) + 1) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def archive(records: DataFrame, folder: str, file_bytes: int = FILE) -> None:
    records.sparkSession.dataSource.register(Warc)
    records.write.format("warc").option("fileBytes", file_bytes).mode("append").save(folder)


def archived(spark: SparkSession, folder: str, split_bytes: int = SPLIT) -> DataFrame:
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("splitBytes", split_bytes).load(folder)


def with_payloads(records: DataFrame) -> DataFrame:
    """Revisits with the payload of the response that they refer to; null where the archives lack it."""
    held = records.filter("record_type = 'response'").select(F.col("record_id").alias("held_id"), F.col("payload").alias("held"))
    met = records.join(held, (F.col("record_type") == "revisit") & (F.col("refers_to") == F.col("held_id")), "left")
    return met.withColumn("payload", F.coalesce("payload", "held")).drop("held_id", "held")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    archive(page_records(table(spark, sf_dir, "pages")), folder)
    page = lambda c: F.expr(f"try_cast(split({c}, ':')[2] as long)")
    read = archived(spark, folder).filter("record_type in ('response', 'revisit')")
    return read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op13_sql() -> str:
    letters = ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {k}, 5))::INT >> {shift}) & 31) + 1, 1)" for k in range(1, 41, 5) for shift in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
  r AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_id,
          row_number() OVER (PARTITION BY html ORDER BY page_id) = 1 AS first FROM p)
SELECT page_id, payload_bytes, concat({letters}) AS payload_digest, CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT first THEN first_id END AS refers_to FROM r"""
