"""WARC files (news crawls) as a Spark data source: `warc`.

    spark.dataSource.register(WarcSource)
    spark.read.format("warc").option("splitBytes", 1 << 26).load(path)

Files are cut into byte ranges, one partition each; a record belongs to the range in which its first byte lies. A range
that begins inside a record looks for the next one: for compressed files a gzip member that unpacks to a record's first
line, for plain files a record's first line behind an empty one, with a length and an id in its head. What cannot be
read is a row with an error, and reading goes on at the next record. Paths are anything that Arrow's file systems open.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT, BLOCK = 1 << 26, 1 << 20
#: A longer head is no head; a longer payload is an error row, not memory.
MAX_HEAD, MAX_PAYLOAD = 1 << 16, 1 << 28
_GZIP, _FIRST = b"\x1f\x8b\x08", re.compile(rb"WARC/\d\.\d\r?\n")
_SCHEMA = "file string, offset long, type string, url string, date string, payload binary, error string"


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    size: int

    def __init__(self, file: str, start: int, end: int, size: int) -> None:
        super().__init__((file, start))
        self.file, self.start, self.end, self.size = file, start, end, size


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT))))


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        system, at = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(at)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")):
                out += [Range(f.path, a, min(a + self.split, f.size), f.size) for a in range(0, f.size, self.split)]
        return out

    def read(self, part: Range | None) -> Iterator[tuple]:
        if part is None:  # a folder without files
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(part.file) as raw:
            packed = raw.read_at(3, 0) == _GZIP
            yield from (Packed if packed else Plain)(raw, part).rows()


class Plain:
    """Records of one range of a plain file."""

    def __init__(self, raw, part: Range) -> None:
        self.raw, self.part = raw, part

    def bytes(self, at: int, n: int) -> bytes:
        return self.raw.read_at(max(0, min(n, self.part.size - at)), at)

    def head(self, at: int) -> tuple[dict[str, str], int] | None:
        """A record's head and where its payload begins, or None."""
        some = self.bytes(at, 4096)
        if not _FIRST.match(some):
            return None
        if b"\r\n\r\n" not in some:
            some = self.bytes(at, MAX_HEAD)
        return parsed(some, at)

    def next(self, at: int) -> int | None:
        """Where the next record begins, from `at` on."""
        while at < self.part.size:
            some = self.bytes(at, BLOCK + 16)
            for m in _FIRST.finditer(some):
                where = at + m.start()
                if m.start() < BLOCK and (where == 0 or self.bytes(max(0, where - 4), min(4, where)).endswith((b"\n\n", b"\n\r\n"))) and self.head(where):
                    return where
            at += BLOCK
        return None

    def rows(self) -> Iterator[tuple]:
        at = self.next(self.part.start)
        while at is not None and at < self.part.end:
            head = self.head(at)
            if head is None:
                if not self.bytes(at, self.part.size - at if self.part.size - at < 64 else 64).strip():
                    at = self.next(at)
                    continue
                yield (self.part.file, at, None, None, None, None, "no record here")
                at = self.next(at + 1)
                continue
            fields, body = head
            n = int(fields["content-length"])
            payload = self.bytes(body, n) if n <= MAX_PAYLOAD else b""
            error = "payload is too long" if n > MAX_PAYLOAD else "file ends inside the record" if len(payload) < n else None
            yield (self.part.file, at, *told(fields), None if error else payload, error)
            at = body + n
            while (gap := self.bytes(at, 4)) and gap[:1] in b"\r\n":
                at += len(gap) - len(gap.lstrip(b"\r\n"))
            at = None if at >= self.part.size else at


def parsed(some: bytes, at: int) -> tuple[dict[str, str], int] | None:
    end = some.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = some[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    if not fields.get("content-length", "").isdigit() or "warc-record-id" not in fields:
        return None
    return fields, at + end + 4


def told(fields: dict[str, str]) -> tuple:
    return fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-date")


class Packed(Plain):
    """Records of one range of a file of gzip members."""

    def next(self, at: int) -> int | None:
        while at < self.part.size:
            some = self.bytes(at, BLOCK + 2)
            k = some.find(_GZIP)
            while k >= 0:
                try:
                    first = zlib.decompressobj(31).decompress(self.bytes(at + k, 4096), 16)
                    if _FIRST.match(first):
                        return at + k
                except zlib.error:
                    pass
                k = some.find(_GZIP, k + 1)
            at += BLOCK
        return None

    def rows(self) -> Iterator[tuple]:
        at = self.next(self.part.start)
        while at is not None and at < self.part.end:
            unpacked, end, error = self.member(at)
            if error:
                yield (self.part.file, at, None, None, None, None, error)
                at = self.next(at + 1)
                continue
            k = 0
            while k < len(unpacked) and unpacked[k:].strip(b"\r\n"):
                head = parsed(unpacked[k : k + MAX_HEAD], k) if _FIRST.match(unpacked, k) else None
                if head is None:
                    yield (self.part.file, at, None, None, None, None, "no record here")
                    break
                fields, body = head
                n = int(fields["content-length"])
                short = body + n > len(unpacked)
                yield (self.part.file, at, *told(fields), None if short else unpacked[body : body + n], "member ends inside the record" if short else None)
                k = body + n
                while unpacked[k : k + 1] in (b"\r", b"\n"):
                    k += 1
            at = None if end >= self.part.size else end if self.bytes(end, 3) == _GZIP else self.next(end)

    def member(self, at: int) -> tuple[bytes, int, str | None]:
        """What a member unpacks to, where it ends, and an error."""
        z, out, size, where = zlib.decompressobj(31), [], 0, at
        try:
            while not z.eof:
                some = self.bytes(where, BLOCK)
                if not some:
                    return b"", where, "file ends inside the member"
                where += len(some)
                while some and not z.eof:
                    got = z.decompress(some, BLOCK)
                    some = z.unconsumed_tail
                    size += len(got)
                    if size > MAX_PAYLOAD:
                        return b"", where, "member is too long"
                    out.append(got)
        except zlib.error as e:
            return b"", where, str(e)
        return b"".join(out), where - len(z.unused_data), None


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The records of a file or folder."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("splitBytes", str(split)).load()


def http_body(payload: Column) -> Column:
    """The text of an HTTP answer: what follows its head."""
    return F.regexp_replace(payload.cast("string"), r"(?s)\A.*?\r?\n\r?\n", "")


def pages(records: DataFrame) -> DataFrame:
    """(url, date, html) of the responses among the records that could be read."""
    return records.where("type = 'response' AND error IS NULL").select("url", "date", http_body(F.col("payload")).alias("html"))
