"""Archives and token files as tables that are read in byte ranges.

Spark's binary source gives whole files. The two sources here plan ranges of them, so that
one large file is many tasks', each with a buffer's worth in memory: compressed archives
from one member to the next, token files by position.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from millrace.sources.sinks import folder_uri
from millrace.sources.web import records_of

READ_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08"


def listed(uri: str, glob: str) -> list[tuple[str, int, int]]:
    """``(path, bytes, time)`` of the files below a folder, by path."""
    fs, base = pafs.FileSystem.from_uri(uri)
    found = fs.get_file_info(base) if fs.get_file_info(base).is_file else fs.get_file_info(pafs.FileSelector(base, recursive=True))
    files = [x for x in (found if isinstance(found, list) else [found]) if x.is_file and fnmatch(x.base_name, glob)]
    return sorted((x.path, x.size, x.mtime_ns or 0) for x in files)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    first: int = 0  # position of the first token


class _Member(io.RawIOBase):
    """The content of the compressed member that begins at ``start``, read as it is decompressed; ``after`` is where it ended."""

    def __init__(self, f, start: int):
        self.f, self.at, self.after, self.held = f, start, None, b""
        self.inner = zlib.decompressobj(31)
        f.seek(start)

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.held and not self.inner.eof:
            data = self.inner.unconsumed_tail
            if not data:
                data = self.f.read(READ_BYTES)
                self.at += len(data)
                if not data:
                    raise EOFError("an archive member is cut off")
            self.held = self.inner.decompress(data, READ_BYTES)
            if self.inner.eof:
                self.after = self.at - len(self.inner.unused_data)
        n = min(len(out), len(self.held))
        out[:n], self.held = self.held[:n], self.held[n:]
        return n


def _begins(f, at: int) -> bool:
    """Whether a member of an archive begins here, and not only its three signs by chance."""
    f.seek(at)
    try:
        return zlib.decompressobj(31).decompress(f.read(4096), 64)[:5] in (b"WARC/", b"")
    except zlib.error:
        return False


def next_member(f, start: int, end: int) -> int | None:
    """Where the first member at ``start`` or later begins, if before ``end``."""
    at = start
    while at < end:
        f.seek(at)
        data = f.read(READ_BYTES + len(MAGIC) - 1)
        place = data.find(MAGIC)
        while 0 <= place < READ_BYTES and at + place < end:
            if _begins(f, at + place):
                return at + place
            place = data.find(MAGIC, place + 1)
        at += READ_BYTES
    return None


def members(uri: str, part: Range) -> Iterator[tuple]:
    """``(path, offset, type, headers, payload)`` of the records of all members that begin in the range, read to their ends."""
    fs, _ = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(part.path) as f:
        at = next_member(f, part.start, part.end)
        while at is not None and at < part.end:
            member = _Member(f, at)
            content = io.BufferedReader(member, READ_BYTES)
            for kind, heads, payload in records_of(content):
                yield part.path, at, kind, heads, payload
            while content.read(READ_BYTES):
                pass
            at = next_member(f, member.after, part.end)


class _Archives(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.glob, self.split = options["uri"], options.get("glob", "*.gz"), int(options.get("splitbytes", 64 << 20))

    def ranges(self, files: list[tuple[str, int, int]]) -> list[Range]:
        return [Range(path, lo, min(lo + self.split, size)) for path, size, _ in files for lo in range(0, size, self.split)]

    def partitions(self) -> list[Range]:
        return self.ranges(listed(self.uri, self.glob))

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from members(self.uri, partition)


class _ArchiveStream(DataSourceStreamReader):
    """Files in the order in which they came; an offset is the last file's time and path."""

    def __init__(self, options: dict):
        self.inner = _Archives(options)

    def initialOffset(self) -> dict:
        return {"time": "0", "path": ""}

    def _files(self) -> list[tuple[str, int, int]]:
        return sorted(listed(self.inner.uri, self.inner.glob), key=lambda x: (x[2], x[0]))

    def latestOffset(self) -> dict:
        files = self._files()
        return {"time": str(files[-1][2]), "path": files[-1][0]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        key = lambda o: (int(o["time"]), o["path"])
        return self.inner.ranges([x for x in self._files() if key(start) < (x[2], x[0]) <= key(end)])

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from members(self.inner.uri, partition)

    def commit(self, end: dict) -> None:
        pass


class ArchiveMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "path string, offset long, rec_type string, headers map<string,string>, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return _Archives(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ArchiveStream(self.options)


class _Tokens(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.glob, self.split = options["uri"], options.get("glob", "*.bin"), int(options.get("splittokens", 8 << 20))
        self.wanted = json.loads(options.get("ranges", "null"))

    def partitions(self) -> list[Range]:
        """Only the bytes of the wanted positions, in pieces of ``splitTokens``."""
        out, first = [], 0
        for path, size, _ in listed(self.uri, self.glob):
            n = size // 2
            for lo, hi in [(0, first + n)] if self.wanted is None else self.wanted:
                lo, hi = max(lo, first), min(hi, first + n)
                out += [Range(path, 2 * (at - first), 2 * (min(at + self.split, hi) - first), at) for at in range(lo, hi, self.split)]
            first += n
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end == partition.start:
            return
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        with fs.open_input_file(partition.path) as f:
            f.seek(partition.start)
            at, left = partition.first, partition.end - partition.start
            while left:
                data = f.read(min(left, READ_BYTES))
                if not data:
                    raise EOFError(f"{partition.path} is shorter than when it was listed")
                tokens = np.frombuffer(data[: len(data) // 2 * 2], "<u2").astype(np.int32)
                yield pa.record_batch([pa.array(np.arange(at, at + len(tokens))), pa.array(tokens)], ["pos", "token"])
                at, left = at + len(tokens), left - 2 * len(tokens)
                f.seek(partition.end - left)


class TokenFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "pos long, token int"

    def reader(self, schema) -> DataSourceReader:
        return _Tokens(self.options)


def next_delimiter(f, start: int, size: int, delimiter: bytes, after: bool) -> int:
    """Where the first delimiter at ``start`` or later begins, or ends if ``after``; the file's end if there is none."""
    at, lap = start, len(delimiter) - 1
    while at < size:
        f.seek(at)
        data = f.read(READ_BYTES + lap)
        place = data.find(delimiter)
        if place >= 0:
            return at + place + (len(delimiter) if after else 0)
        at += READ_BYTES
    return size


class _Chunks(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.glob, self.size = options["uri"], options.get("glob", "*"), int(options["chunkbytes"])
        self.delimiter, self.after = bytes.fromhex(options["delimiter"]), options.get("after", "false") == "true"

    def partitions(self) -> list[Range]:
        found = [Range(path, lo, min(lo + self.size, size), size) for path, size, _ in listed(self.uri, self.glob) for lo in range(0, size, self.size)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        size = partition.first
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        with fs.open_input_file(partition.path) as f:
            cut = lambda at: at if at in (0, size) else next_delimiter(f, at, size, self.delimiter, self.after)
            start, end = cut(partition.start), cut(partition.end)
            if start < end:
                f.seek(start)
                yield partition.path, start, end, f.read(end - start)


class DelimitedChunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "delimited_chunks"

    def schema(self) -> str:
        return "path string, start long, end long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Chunks(self.options)


def delimited_chunks(spark: SparkSession, path: str, delimiter: str = "<|endoftext|>", chunk_bytes: int = 64 << 20, after: bool = False, glob: str = "*") -> DataFrame:
    """``(path, start, end, content)``: files cut near every ``chunk_bytes``, each cut moved on to the next delimiter.

    A chunk begins with a delimiter, or after one; cuts that meet make one chunk, and all chunks of a file are the file. A task
    holds one chunk: ``chunk_bytes`` and at most a document more."""
    spark.dataSource.register(DelimitedChunks)
    options = {"uri": folder_uri(spark, path), "glob": glob, "chunkBytes": str(chunk_bytes), "delimiter": delimiter.encode().hex(), "after": str(after).lower()}
    return spark.read.format("delimited_chunks").options(**options).load()


def read_archives(spark: SparkSession, path: str, glob: str = "*.gz", split_bytes: int = 64 << 20, stream: bool = False) -> DataFrame:
    """``(path, offset, rec_type, headers, payload)`` of the records of compressed archives, as a table or a stream of
    arriving files; ``offset`` is where a record's member begins.

    Files are cut into ranges of ``split_bytes``; a range's task seeks the first member that
    begins in it and reads members to their ends, so each record is read once, whatever the
    ranges. A task holds one record and two buffers of ``READ_BYTES``; an archive of a single
    member is one task's. Files are read through Arrow's file systems."""
    spark.dataSource.register(ArchiveMembers)
    reader = spark.readStream if stream else spark.read
    return reader.format("archive_members").options(uri=folder_uri(spark, path), glob=glob, splitBytes=str(split_bytes)).load()


def read_tokens(spark: SparkSession, path: str, ranges: list[tuple[int, int]] | None = None, glob: str = "*.bin", split_tokens: int = 8 << 20) -> DataFrame:
    """``(pos, token)`` of files of little-endian 16-bit numbers, taken as one stream in the order of their names.

    With ``ranges`` only the positions from a range's first up to its second are read, and no other
    bytes. A task reads at most ``split_tokens`` tokens, a buffer at a time."""
    spark.dataSource.register(TokenFiles)
    options = {"uri": folder_uri(spark, path), "glob": glob, "splitTokens": str(split_tokens)} | ({} if ranges is None else {"ranges": json.dumps(ranges)})
    return spark.read.format("token_files").options(**options).load()
