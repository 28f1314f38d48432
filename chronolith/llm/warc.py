"""WARC archives as a PySpark data source.

Reading plans a partition for each run of archive files, takes filters on the record type and the
headers, parses a record's headers first, and inflates and decodes a payload only where the
record passes and payloads are wanted. Every record is a gzip member of its own. Writing rolls over
to a new file at ``ROLL`` bytes; a task's files appear under their names only when the whole write is
committed, so lost or repeated tasks leave no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from chronolith.llm.common import cut, new_path, ship

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_length bigint, payload binary"
FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length",
}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL, BATCH, REVISIT_LEAST = 64_000_000, 32_000_000, 1000


class Store:
    """Files of a folder: this machine's where the path is local, else by pyarrow."""

    def __init__(self, path: str) -> None:
        plain = path.removeprefix("file://").removeprefix("file:")
        self.remote = None
        if "://" in plain:
            from pyarrow import fs

            self.remote, plain = fs.FileSystem.from_uri(plain)
        self.path = plain

    def make(self) -> None:
        self.remote.create_dir(self.path) if self.remote else os.makedirs(self.path, exist_ok=True)

    def list(self) -> list[tuple[str, int]]:
        if self.remote:
            from pyarrow import fs

            found = [(f.base_name, f.size) for f in self.remote.get_file_info(fs.FileSelector(self.path)) if f.is_file]
        else:
            found = [(e.name, e.stat().st_size) for e in os.scandir(self.path) if e.is_file()]
        return sorted(f for f in found if f[0].endswith(".warc.gz"))

    def read(self, name: str) -> io.BufferedIOBase:
        full = f"{self.path}/{name}"
        return self.remote.open_input_stream(full) if self.remote else open(full, "rb")  # noqa: SIM115

    def write(self, name: str) -> io.BufferedIOBase:
        full = f"{self.path}/{name}"
        return self.remote.open_output_stream(full) if self.remote else open(full, "wb")  # noqa: SIM115

    def move(self, name: str, to: str) -> None:
        a, b = f"{self.path}/{name}", f"{self.path}/{to}"
        self.remote.move(a, b) if self.remote else os.replace(a, b)

    def remove(self, name: str) -> None:
        try:
            self.remote.delete_file(f"{self.path}/{name}") if self.remote else os.remove(f"{self.path}/{name}")
        except OSError:
            pass


def digest_header(sha1: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()


def digest_hex(header: str | None) -> str | None:
    return base64.b32decode(header.removeprefix("sha1:")).hex() if header else None


def record(row) -> bytes:
    """The bytes of a row of SCHEMA, as one gzip member; payload_digest is bare hexadecimal."""
    head = [f"{FIELDS[k]}: {row[k]}" for k in ("record_type", "record_id", "target_uri", "date", "refers_to") if row[k] is not None]
    head += [f"WARC-Payload-Digest: {digest_header(row['payload_digest'])}", f"X-Payload-Length: {row['payload_length']}"]
    payload = row["payload"]
    if row["record_type"] == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
    body = HTTP % row["payload_length"] + (bytes(payload) if payload is not None else b"")
    head = ["WARC/1.1", *(h.replace("\r", "%0D").replace("\n", "%0A") for h in head), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


class Members:
    """Inflates a file's gzip members one after another, as far as asked."""

    def __init__(self, file: io.BufferedIOBase) -> None:
        self.file, self.rest = file, b""

    def more(self) -> bool:
        if not self.rest:
            self.rest = self.file.read(1 << 18)
        return bool(self.rest)

    def __iter__(self) -> Iterator[tuple[dict[str, str], "Members"]]:
        while self.more():
            self.unpack, self.held = zlib.decompressobj(31), b""
            while b"\r\n\r\n" not in self.held:
                if not self._pull(512):
                    raise ValueError("a record's headers end early")
            head, _, self.held = self.held.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            yield dict(x.split(": ", 1) for x in lines[1:]), self
            while not self.unpack.eof:  # to the member's end, keeping nothing
                self.held = b""
                if not self._pull(1 << 16):
                    raise ValueError("a record ends early")

    def _pull(self, most: int) -> bool:
        """Inflate some bytes; False at the end of the member or file."""
        if self.unpack.eof or not (self.unpack.unconsumed_tail or self.more()):
            return False
        given = self.unpack.unconsumed_tail or self.rest
        got = self.unpack.decompress(given, most)
        if given is self.rest or not self.unpack.unconsumed_tail:
            self.rest = b""
        if self.unpack.eof:
            self.rest = self.unpack.unused_data + b""
        self.held += got
        return True

    def body(self, length: int) -> bytes:
        parts, size = [self.held], len(self.held)
        while size < length:
            self.held = b""
            if not self._pull(1 << 16):
                raise ValueError("a record's body ends early")
            parts.append(self.held)
            size += len(self.held)
        self.held = b""
        return b"".join(parts)[:length]


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Done(WriterCommitMessage):
    names: list[str]


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payload", "false").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options, overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple[str, tuple | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, membership and presence of header columns are tested here; all others go back to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull)) and f.attribute[0] in FIELDS and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], None if isinstance(f, IsNotNull) else (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out, size = [], BATCH
        for name, length in Store(self.path).list():
            if size + length > BATCH:
                out.append(Files([]))
                size = 0
            out[-1].names.append(name)
            size += length
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store = Store(self.path)
        for name in partition.names:
            with store.read(name) as file:
                for head, member in Members(file):
                    row = {k: head.get(h) for k, h in FIELDS.items()}
                    row["payload_digest"] = digest_hex(row["payload_digest"])
                    row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
                    if any(row[k] is None or values is not None and row[k] not in values for k, values in self.tests):
                        continue
                    payload = None
                    if self.payload and row["record_type"] == "response":
                        payload = member.body(int(head["Content-Length"])).partition(b"\r\n\r\n")[2]
                    yield (*row.values(), payload)


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        Store(self.path).make()
        self.before = [n for n, _ in Store(self.path).list()] if overwrite else []

    def write(self, rows: Iterator) -> Done:
        store, names, file, size = Store(self.path), [], None, 0
        try:
            for row in rows:
                if file is None or size >= ROLL:
                    if file is not None:
                        file.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz.part")
                    file, size = store.write(names[-1]), 0
                data = record(row)
                file.write(data)
                size += len(data)
        finally:
            if file is not None:
                file.close()
        return Done(names)

    def commit(self, messages: list) -> None:
        store = Store(self.path)
        for m in messages:
            for name in m.names if m else ():
                store.move(name, name.removesuffix(".part"))
        for name in self.before:
            store.remove(name)

    def abort(self, messages: list) -> None:
        store = Store(self.path)
        for m in messages:
            for name in m.names if m else ():
                store.remove(name)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


#: What names a payload: its length and two digests.
PAYLOAD = ("n", "a", "b")


def _named(pages: DataFrame) -> DataFrame:
    """``page_id, url, body`` and PAYLOAD of every row."""
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", body.alias("body"))
    return rows.select("*", F.octet_length("body").alias("n"), F.sha1("body").alias("a"), F.xxhash64("body").alias("b"))


def revisits(pages: DataFrame) -> DataFrame:
    """``page_id``, PAYLOAD and ``refers_to`` of what is a revisit, each once.

    Of equal payloads of ``REVISIT_LEAST`` bytes or more the largest page_id is the response. Only
    digests meet, never payloads; equality of payloads is that of their length and two digests.
    """
    rows = _named(pages).select("page_id", *PAYLOAD).where(F.col("n") >= REVISIT_LEAST)
    groups = rows.groupBy(*PAYLOAD).agg(F.count("*").alias("k"), F.max("page_id").alias("refers_to")).where("k > 1").drop("k")
    return rows.distinct().join(groups, list(PAYLOAD)).where("page_id <> refers_to").select("page_id", *PAYLOAD, "refers_to")


def write_pages(pages: DataFrame, path: str) -> None:
    """A record for each row of pages, into archives at ``path``.

    Null html is an empty payload. A null page_id is never a revisit. A page_id may have several rows, alike or not: each gives
    a record, judged by its own payload; equal payloads under the largest page_id are all responses. Line breaks in an url are escaped.
    """
    spark = pages.sparkSession
    register(spark)
    of = cut(revisits(pages))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    rows = _named(pages).join(of, ["page_id", *PAYLOAD], "left")
    again = F.col("refers_to").isNotNull()
    rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.coalesce("url", F.lit("")).alias("target_uri"),
        F.lit("2000-01-01T00:00:00Z").alias("date"),
        F.when(again, urn(F.col("refers_to"))).alias("refers_to"),
        F.col("a").alias("payload_digest"),
        F.col("n").cast("bigint").alias("payload_length"),
        F.when(~again, F.col("body")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_of(urn):
    return F.regexp_extract(urn, "urn:page:(-?[0-9]+)>", 1)


def round_trip(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` as read back from the archives.

    A response's length and digest are those of the payload read; a revisit has them in its headers.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_pages(pages, path)
    rows, kind = read_pages(spark, path), pages.schema["page_id"].dataType
    number = lambda c: F.when(page_of(F.col(c)) != "", page_of(F.col(c))).cast(kind)
    return rows.select(
        number("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("bigint"), "payload_length").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
