"""WARC archives as a Spark data source, and their records with identical payloads as revisits.

``spark.dataSource.register(WarcSource)``, then ``spark.read.format("warc").load(folder)`` and
``frame.write.format("warc").mode("append").save(folder)``.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from . import store

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary"
#: The fields of a record's head, by column.
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "WARC-Payload-Length",
}
BRACKETED = ("record_id", "refers_to")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD_BYTES = 8192


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A field's value on one line, whatever it holds."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record_bytes(row: dict) -> bytes:
    """A record; a revisit has the head of the answer only."""
    payload = row.get("payload") or b""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = row.get("payload_digest") or "sha1:" + base32_sha1(payload)
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row.get("date") or "1970-01-01T00:00:00Z")]
    if row.get("target_uri") is not None:
        fields.append(("WARC-Target-URI", row["target_uri"]))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{row['refers_to']}>")]
    fields += [("WARC-Payload-Digest", digest), ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(record: bytes, level: int = 4) -> bytes:
    """A gzip member of one record, with the skip lengths (field ``sl``: of the member, and of the record) in its head."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = deflate.compress(record) + deflate.flush()
    size = 12 + 12 + len(data) + 8
    sizes = (size, len(record)) if max(size, len(record)) < 1 << 32 else (0, 0)
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, *sizes)
    return head + data + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def parsed_head(head: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of a record's head, and its length; None if it isn't all there."""
    end = head.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in head[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


def _row(fields: dict[str, str]) -> dict:
    out = {column: fields.get(name.lower()) for column, name in FIELDS.items()}
    for column in BRACKETED:
        if out[column] is not None:
            out[column] = out[column].removeprefix("<").removesuffix(">")
    if out["target_uri"] is not None and ("%0D" in out["target_uri"] or "%0A" in out["target_uri"]):
        out["target_uri"] = out["target_uri"].replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    length = out["payload_length"]
    out["payload_length"] = int(length) if length and length.isdigit() else None
    return out


def _payload(block: bytes) -> bytes:
    """What follows the head of the answer."""
    if not block.startswith(b"HTTP/"):
        return block
    return block.partition(b"\r\n\r\n")[2]


@dataclass
class Wanted:
    """Which records are asked for, by their heads: column to allowed values. Payloads are left out if ``payloads`` is off."""

    allowed: dict[str, list]
    payloads: bool = True

    def takes(self, row: dict) -> bool:
        return all(row[column] in values for column, values in self.allowed.items())


def read_compressed(source: io.BufferedIOBase, wanted: Wanted) -> Iterator[dict]:
    """Records of a file of one gzip member for each; the rest of an unwanted one is neither inflated nor, if its length is known, read."""
    buffer = b""
    while True:
        while len(buffer) < 24 and (more := source.read(1 << 16)):
            buffer += more
        if not buffer:
            return
        size = 0
        if len(buffer) >= 24 and buffer[3] & 4 and buffer[12:14] == b"sl":
            size = struct.unpack("<I", buffer[16:20])[0]
        if size and len(buffer) < size:
            have = buffer + source.read(min(size, HEAD_BYTES) - len(buffer)) if len(buffer) < min(size, HEAD_BYTES) else buffer
        else:
            have = buffer
        inflate = zlib.decompressobj(31)
        record = inflate.decompress(have, HEAD_BYTES)
        left = size - len(have)
        while (head := parsed_head(record)) is None and not inflate.eof:
            if not inflate.unconsumed_tail:
                more = source.read(min(left, 1 << 16) if size else 1 << 16)
                left -= len(more)
                if not more:
                    raise ValueError("an archive ends within a record's head")
            else:
                more = b""
            record += inflate.decompress(inflate.unconsumed_tail + more, HEAD_BYTES)
        if head is None:
            raise ValueError("a record without a head")
        row = _row(head[0])
        take = wanted.takes(row)
        if size and not (take and wanted.payloads):
            # Past the record, without inflating it.
            if left > 0:
                source.seek(left, io.SEEK_CUR)
                buffer = b""
            else:
                buffer = have[size:]
        else:
            parts, keep = [record], take and wanted.payloads
            if size and left > 0:
                parts.append(inflate.decompress(inflate.unconsumed_tail + source.read(left)))
            else:
                tail = inflate.unconsumed_tail
                while not inflate.eof:
                    piece = inflate.decompress(tail or source.read(1 << 16))
                    tail = inflate.unconsumed_tail
                    if keep:
                        parts.append(piece)
                    elif not piece and not tail and inflate.eof:
                        break
            buffer = inflate.unused_data
            if keep:
                whole = b"".join(parts)
                length = int(head[0].get("content-length", len(whole)))
                row["payload"] = _payload(whole[head[1] : head[1] + length])
        if take:
            yield row


def read_plain(source: io.BufferedIOBase, wanted: Wanted) -> Iterator[dict]:
    """Records of a file that isn't compressed; the block of an unwanted one is passed over."""
    while True:
        at, head = source.tell(), b""
        while (found := parsed_head(head)) is None:
            more = source.read(HEAD_BYTES)
            if not more:
                if head.strip():
                    raise ValueError("an archive ends within a record's head")
                return
            head += more
        length = int(found[0].get("content-length", 0))
        row = _row(found[0])
        take = wanted.takes(row)
        if take and wanted.payloads:
            source.seek(at + found[1])
            row["payload"] = _payload(source.read(length))
        source.seek(at + found[1] + length + 4)
        if take:
            yield row


@dataclass
class Files(InputPartition):
    """Whole files that one task reads."""

    names: list[str]


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


class WarcReader(DataSourceReader):
    """Plans files by size; type and other fields of the head are tested before anything else is decoded."""

    def __init__(self, options: dict, schema: pa.Schema):
        self.path, self.arrow_schema = options["path"], schema
        self.most = int(options.get("partition_bytes", 64 << 20))
        self.wanted = Wanted({}, options.get("payloads", "true").lower() == "true")

    def pushFilters(self, filters):  # noqa: N802
        for found in filters:
            column = found.attribute[0] if hasattr(found, "attribute") and len(found.attribute) == 1 else None
            if column in FIELDS and isinstance(found, (EqualTo, In)):
                values = list(found.value) if isinstance(found, In) else [found.value]
                before = self.wanted.allowed.get(column)
                self.wanted.allowed[column] = values if before is None else [v for v in values if v in before]
            elif not (isinstance(found, IsNotNull) and column == "record_type"):
                yield found

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, path = _file_system(self.path)
        found = system.get_file_info(fs.FileSelector(path)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        out, size = [Files([])], 0
        for file in sorted((f for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz"))), key=lambda f: f.base_name):
            if out[-1].names and size + file.size > self.most:
                out.append(Files([]))
                size = 0
            out[-1].names.append(file.path)
            size += file.size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.path)
        rows, size = [], 0
        for name in partition.names:
            with system.open_input_file(name) as source:
                for row in (read_compressed if name.endswith(".gz") else read_plain)(source, self.wanted):
                    rows.append({"payload": None} | row)
                    size += len(rows[-1]["payload"] or b"") + 500
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, self.arrow_schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.arrow_schema)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own under ``_writing``; only those of tasks that succeeded are moved to where readers look."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("file_bytes", 256 << 20))
        self.compressed = options.get("compression", "gzip") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _file_system(self.path)
        system.create_dir(f"{path}/_writing", recursive=True)
        names, out = [], None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or out.tell() > self.most:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.compressed)
                    out = system.open_output_stream(f"{path}/_writing/{names[-1]}", compression=None)
                record = record_bytes(row)
                out.write(member(record) if self.compressed else record)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        system, path = _file_system(self.path)
        for message in messages:
            for name in message.names if message else []:
                system.move(f"{path}/_writing/{name}", f"{path}/{name}")

    def abort(self, messages) -> None:
        """What failed tasks wrote stays under ``_writing``, where no reader looks."""


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return WarcReader(self.options, to_arrow_schema(schema))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32(hexadecimal: Column) -> Column:
    """A hex SHA-1 in base 32: four groups of 40 bits, eight signs each.

    The groups each name the hash, so it should be a column of a select before, not an expression that would be worked out for each.
    """
    digits = F.concat(*[F.lpad(F.conv(F.substring(hexadecimal, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A WARC record for each row of ``pages`` (page_id, url, html).

    Of records with equal payloads of at least ``least_bytes`` bytes that with the largest page_id is the response, the others are revisits
    of it; rows that repeat that page_id are responses too. A null html is an empty payload; a null page_id is never revisited if
    the payload has another. Payloads are told apart by SHA-1 and length; a group of any size is a partial maximum and a
    join that Spark can split.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"sha1": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    shared = rows.where(F.col("payload_length") >= least_bytes).groupBy("sha1", "payload_length").agg(F.count("*").alias("n"), F.max("page_id").alias("original")).where("n > 1")
    joined = rows.join(shared.select("sha1", "payload_length", "original"), ["sha1", "payload_length"], "left")
    revisit = F.coalesce(F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")), F.lit(False))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), F.col("url").alias("target_uri"), F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.when(revisit, urn("original")).alias("refers_to"), F.concat(F.lit("sha1:"), base32(F.col("sha1"))).alias("payload_digest"), "payload_length", "payload",
    )


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from archives of ``pages``.

    Responses are measured by their payloads as they come back. Revisits are told by their heads alone; a filter on the
    type is pushed to the source, and the payloads aren't decoded for it.
    """
    spark = pages.sparkSession
    register(spark)
    path = store.new_path(spark, "warc")
    records(pages, least_bytes).write.format("warc").mode("append").save(path)
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    back = spark.read.format("warc").load(path)
    # A payload is hashed in a select of its own: once, however often its digest's expression names the hash.
    measured = back.where("record_type = 'response'").select("record_id", "record_type", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"))
    responses = measured.select(number("record_id").alias("page_id"), "payload_bytes", base32(F.col("sha1")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    heads = spark.read.format("warc").option("payloads", "false").load(path).where("record_type = 'revisit'")
    revisits = heads.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    return responses.union(revisits)
