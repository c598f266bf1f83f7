"""WARC archives in Zstandard: one frame a record, dictionary in a leading skippable frame.

The reader takes archives as Spark's ``binaryFile`` source gives them, so they may be in
any store that Spark reads. It finds the frames by walking their block headers, decodes
each with the archive's dictionary, and checks headers, lengths and payload digests.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.scratch import Scratch, join_small

# Fixed values of the formats
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 32 << 10
DICTIONARY_SAMPLE = 400
READ_SCHEMA = (
    "archive string, record_type string, record_id string, target_uri string, page_id long, refers_to long, "
    "payload_digest string, payload binary, content_length long"
)


class WarcError(ValueError):
    """An archive that breaks the format."""


def make_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples; their raw text if they are too few to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _header_value(x: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", x)


def _record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def record_bytes(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    block = HTTP_HEAD + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, url, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, refers_url, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
        if refers_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_header_value(refers_url)}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, by its block headers."""
    head = bytes(data[at : at + 18])
    try:
        size = zstandard.frame_header_size(head)
        checksum = zstandard.get_frame_parameters(head).has_checksum
    except zstandard.ZstdError as e:
        raise WarcError(f"bad frame header at byte {at}: {e}") from e
    at += size
    while True:
        if at + 3 > len(data):
            raise WarcError("an archive ends within a frame")
        word = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if word >> 1 & 3 == 1 else word >> 3)
        if word & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise WarcError("an archive ends within a frame")
    return at


def read_frames(data: bytes) -> Iterator[bytes]:
    """The decoded records of an archive, none of an empty one; a ``WarcError`` where a frame breaks off."""
    view, at, words, opener = memoryview(data), 0, b"", None
    while at < len(view):
        if at + 8 > len(view):
            raise WarcError(f"no frame at byte {at}")
        magic, size = struct.unpack("<II", view[at : at + 8])
        if magic in SKIPPABLE:
            if at + 8 + size > len(view):
                raise WarcError("an archive ends within a skippable frame")
            if magic == DICTIONARY_MAGIC and at == 0:
                raw = bytes(view[8 : 8 + size])
                words = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == struct.pack("<I", FRAME_MAGIC) else raw
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = _frame_end(view, at)
            opener = opener or zstandard.ZstdDecompressor(dict_data=_dictionary(words))  # one an archive
            try:
                yield opener.decompressobj().decompress(view[at:end])
            except zstandard.ZstdError as e:
                raise WarcError(f"bad frame at byte {at}: {e}") from e
            at = end
        else:
            raise WarcError(f"no frame at byte {at}")


def parse_record(record: bytes) -> dict:
    """Headers and payload of one record, checked."""
    cut = record.find(b"\r\n\r\n")
    if cut < 0:
        raise WarcError("a record's headers do not end")
    first, *lines = record[:cut].decode("utf-8").split("\r\n")
    if not re.fullmatch(r"WARC/1\.\d", first):
        raise WarcError(f"not a WARC version: {first[:20]!r}")
    heads = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name:
            raise WarcError(f"not a header: {line[:40]!r}")
        heads[name.lower()] = value.strip()
    missing = [n for n in ("warc-type", "warc-record-id", "warc-date", "content-length") if n not in heads]
    if missing:
        raise WarcError(f"headers missing: {missing}")
    length, block = heads["content-length"], record[cut + 4 : -4]
    if not length.isdigit() or int(length) != len(block) or record[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length} of a block of {len(block)} bytes")
    payload = block
    if heads.get("content-type", "").startswith("application/http"):
        head, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise WarcError("an HTTP block's headers do not end")
    digest = heads.get("warc-payload-digest", "")
    if heads["warc-type"] == "response" and digest.startswith("sha256:") and digest[7:] != hashlib.sha256(payload).hexdigest():
        raise WarcError("the payload differs from its digest")
    return heads | {"payload": payload, "length": len(block)}


def _write(root: str, words: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        frames: list[bytes] = []
        size = 0
        press = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(words), write_content_size=True)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words if words else b""

        def store() -> pa.RecordBatch:
            # a task that runs twice writes two files; the manifest names those of one run
            name = f"{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(lead)
                f.write(b"".join(frames))
            return pa.record_batch([pa.array([name]), pa.array([len(frames)], pa.int64())], ["name", "records"])

        for b in batches:
            for page_id, url, payload, digest, kind, refers, refers_url in zip(*[c.to_pylist() for c in b.columns]):
                frames.append(press.compress(record_bytes(kind, page_id, url, digest, payload or b"", refers, refers_url)))
                size += len(frames[-1])
                if size >= ARCHIVE_BYTES:
                    yield store()
                    frames, size = [], 0
        if frames:
            yield store()

    return run


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write rows ``(page_id, url, payload, payload_digest, record_type, refers_to, refers_url)`` as
    archives below ``folder``, which driver and executors share; the manifest ``(name, records)``.

    The dictionary is trained on the first 64 KiB of ``DICTIONARY_SAMPLE`` payloads at most.
    Null urls, ids and payloads give records without these; rows that repeat give records
    that repeat; an empty table gives an empty manifest.
    """
    spark = records.sparkSession
    sample = records.where(F.length("payload") > 0).select(F.substring("payload", 1, 1 << 16)).limit(DICTIONARY_SAMPLE)
    words = make_dictionary([bytes(r[0]) for r in sample.collect()])
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    uri = re.sub(r"^file:/+", "file:///", uri)
    own = records.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to", "refers_url")
    return own.mapInArrow(_write(uri, words), "name string, records long")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("archive", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()),
         ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("content_length", pa.int64())]
    )
    number = lambda x: None if x is None else int(x)
    for b in batches:
        for name, content in zip(b.column(0).to_pylist(), b.column(1)):
            rows, size = [], 0
            for record in read_frames(content.as_py()):
                r = parse_record(record)
                rows.append((name, r["warc-type"], r["warc-record-id"], r.get("warc-target-uri"), number(r.get("x-page-id")), number(r.get("x-refers-to-page-id")),
                             r.get("warc-payload-digest", "").removeprefix("sha256:") or None, r["payload"], r["length"]))
                size += r["length"]
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_archives(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """The records of the archives below ``path``, of those in ``names`` if given.

    An archive that breaks the format fails the job with a ``WarcError``. Each archive is
    one task's; writers bound its size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    if names is not None:
        files = join_small(files, names.select("name").distinct(), ["name"], 1_000_000, "left_semi")
    return files.mapInArrow(_parse, READ_SCHEMA)


def archive_report(pages: DataFrame, least_revisit: int = 100) -> DataFrame:
    """Write ``pages`` as archives, read them back: a row for each page.

    Of the pages with equal payloads of at least ``least_revisit`` bytes, the one with the
    least page_id is a response and the others revisit it; all other pages are responses.
    Null html is an empty payload; pages with a null id are responses. Rows that repeat
    the least id are all responses. A revisit's length comes from the record it refers to.
    An empty table gives an empty result.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    same = (
        rows.where((F.octet_length("payload") >= least_revisit) & F.col("page_id").isNotNull())
        .groupBy("payload_digest").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "url")).alias("least")).where("n > 1")
        .select("payload_digest", F.col("least.page_id").alias("first"), F.col("least.url").alias("first_url"))
    )
    same = scratch.save(same, "same")
    revisits = F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first"))
    records = join_small(rows, same, ["payload_digest"], 100_000).select(
        "page_id", "url", "payload", "payload_digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first")).alias("refers_to"), F.when(revisits, F.col("first_url")).alias("refers_url"),
    )
    folder = scratch.path("archives")
    manifest = scratch.save(write_archives(records, folder), "manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    read = read_archives(spark, folder, manifest).select(
        "page_id", F.octet_length("payload").cast("long").alias("n"), "payload_digest", "record_type", "refers_to"
    )
    read = scratch.save(read, "records")
    told = read.where("record_type = 'response'").join(same.select("payload_digest").distinct(), "payload_digest", "left_semi")
    sizes = scratch.save(told.select("payload_digest", F.col("n").alias("full")).distinct(), "sizes")
    return join_small(read, sizes, ["payload_digest"], 100_000).select(
        "page_id", F.when(F.col("record_type") == "revisit", F.col("full")).otherwise(F.col("n")).alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to",
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
    CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first IS NOT NULL AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
