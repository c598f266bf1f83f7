"""Web sources: WET and WARC records, HTML text, token files, delimited text."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.encodings import decoded_page

RECORD_SCHEMA = "path string, rec_type string, headers map<string,string>, payload binary"


BATCH_BYTES = 16 << 20


def raw_records(f: io.BufferedIOBase) -> Iterator[tuple[str, bytes, bytes]]:
    """``(type, whole record, payload)`` of an open WARC file, one record at a time."""
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        head, kind, length = [line], "", 0
        while (line := f.readline()).strip():
            head.append(line)
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"warc-type":
                kind = value.strip().decode("utf-8", "replace")
            elif name.strip().lower() == b"content-length":
                length = int(value)
        payload = f.read(length)
        yield kind, b"".join(head) + b"\r\n" + payload + b"\r\n\r\n", payload


def iter_records(data: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """Records of a WARC file, plain or gzip, as (type, headers, payload), decompressed as it is read."""
    yield from records_of(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))


def records_of(f: io.BufferedIOBase) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """``iter_records`` of an open file, one record at a time."""
    yield from _parsed(raw_records(f))


def _parsed(records: Iterator[tuple[str, bytes, bytes]]) -> Iterator[tuple[str, dict[str, str], bytes]]:
    for kind, raw, payload in records:
        lines = raw[: len(raw) - len(payload) - 4].decode("utf-8", "replace").split("\n")[1:]
        heads = {n.strip().lower(): v.strip() for n, c, v in (x.partition(":") for x in lines) if c}
        yield kind, heads, payload


def _record_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "rec_type", "headers", "payload"]
    for part in parts:
        for name, content in zip(part["path"], part["content"]):
            rows, size = [], 0
            for kind, heads, payload in iter_records(bytes(content)):
                rows.append((name, kind, heads, payload))
                size += len(payload)
                if size >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def read_warc(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Records of all archives below ``path``: a row each, one task a file at most.

    A task holds one archive as it is stored and about ``BATCH_BYTES`` of its records."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInPandas(_record_rows, RECORD_SCHEMA)


def stream_wet(spark: SparkSession, path: str, glob: str = "*.wet.gz") -> DataFrame:
    """Texts of conversion records of the compressed archives that arrive below ``path``, as a stream: url and text."""
    from millrace.sources.splits import read_archives

    return _conversions(read_archives(spark, path, glob, stream=True))


def _conversions(records: DataFrame) -> DataFrame:
    return records.where("rec_type = 'conversion'").select(F.col("headers")["warc-target-uri"].alias("url"), decode_utf8(F.col("payload")).alias("text"))


def read_wet(spark: SparkSession, path: str, glob: str = "*.wet.gz") -> DataFrame:
    """Texts of conversion records of compressed archives, read in byte ranges: url and text, invalid UTF-8 replaced."""
    from millrace.sources.splits import read_archives

    return _conversions(read_archives(spark, path, glob))


@F.pandas_udf(T.StringType())
def decode_utf8(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else bytes(x).decode("utf-8", "replace"))


class _Text(HTMLParser):
    """Visible text: blocks on lines of their own, list items with a bullet."""

    HIDDEN = {"script", "style", "noscript", "template", "head", "svg", "iframe", "object"}
    IN_HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template"}  # any other element ends an open head
    BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "ul", "ol", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6",
              "blockquote", "pre", "form", "figure", "body", "li", "dl", "dt", "dd"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.blocks, self.now, self.mark, self.head = 0, [], [], "", False

    def close_block(self) -> None:
        text = " ".join("".join(self.now).split())
        if text:
            self.blocks.append(self.mark + text)
        self.now, self.mark = [], ""

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self.hidden, self.head = self.hidden + (not self.head), True
            return
        if self.head and self.hidden == 1 and tag not in self.IN_HEAD:
            self.hidden, self.head = 0, False
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "br":
            self.close_block()
        elif tag in self.BLOCKS:
            self.close_block()
            self.mark = "• " if tag == "li" else ""

    def handle_endtag(self, tag):
        if tag == "head":
            self.hidden, self.head = (max(0, self.hidden - 1), False) if self.head else (self.hidden, False)
        elif tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCKS:
            self.close_block()

    def handle_data(self, data):
        if not self.hidden:
            self.now.append(data)


def extract_text(html: str | bytes | None) -> str | None:
    """Visible text of a page, bytes as ``decoded_page`` reads them; null if there is no page."""
    if html is None:
        return None
    if isinstance(html, (bytes, bytearray)):
        html = decoded_page(bytes(html))
    parser = _Text()
    try:
        parser.feed(html)
        parser.close()
    except Exception:
        return None
    parser.close_block()
    return "\n\n".join(parser.blocks)


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(extract_text)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def uint16_tokens(data: pd.Series) -> pd.Series:
    """Ids of a raw little-endian 16-bit token file, as the binaryFile source gives it."""
    return data.map(lambda x: np.frombuffer(bytes(x), "<u2").astype(np.int32))


@F.pandas_udf(T.BinaryType())
def uint16_bytes(ids: pd.Series) -> pd.Series:
    """Ids as raw little-endian 16-bit numbers; larger ids are an error."""

    def pack(x) -> bytes:
        a = np.asarray(x, dtype=np.int64)
        if a.size and (a.min() < 0 or a.max() > 65535):
            raise ValueError("a token id does not fit 16 bits")
        return a.astype("<u2").tobytes()

    return ids.map(pack)


def read_delimited(spark: SparkSession, path: str, delimiter: str = "<|endoftext|>") -> DataFrame:
    """Documents of text files that a delimiter parts; splits are aligned to it."""
    return spark.read.option("lineSep", delimiter).text(path).withColumnRenamed("value", "text").where("text <> ''")


def links(text: Column) -> Column:
    """URLs in a wiki line's references."""
    return F.regexp_extract_all(text, F.lit(r"(?:https?|ftp)://[\w/#~:.?+=&%@!\-]+[\w/#]"), F.lit(0))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256)`` of every file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))
