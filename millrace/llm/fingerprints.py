"""Document fingerprints by order MinHash.

A text's items are its k-mers of code points, each with the number of its earlier
occurrences. For each of ``SKETCHES`` hash functions the ``PICKED`` items with the least
values are put in the order in which they stand in the text and hashed as a tuple. Two
texts share a tuple if they have the same least items in the same order, so the share of
equal tuples falls with edit distance, moved passages included, where a plain MinHash
would see the same set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.hashed_sets import U64, mix

KMER = 8
PICKED = 2
SKETCHES = 64
BLOCK = 4096
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 20_000
_ODD = (mix(np.arange(1, SKETCHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))
_STEP = U64(0xD1342543DE82EF95)
_FULL = np.uint32((1 << 32) - 1)
LONGEST_SORTED = 1 << 22


def _earlier(grams: np.ndarray) -> np.ndarray | None:
    """For each k-mer the number of equal ones before it; none if all are distinct."""
    n = len(grams)
    if n > LONGEST_SORTED:
        order = np.argsort(grams, kind="stable")
        own = grams[order]
    else:  # one sort of the hash's leading bits with the place below them
        bits = U64(n.bit_length())
        key = np.sort((grams >> bits << bits) | np.arange(n, dtype=U64))
        own = key >> bits
    new = np.ones(n, dtype=bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    if new.all():
        return None
    if n <= LONGEST_SORTED:
        order = (key & ((U64(1) << bits) - U64(1))).astype(np.int64)
    at = np.arange(n)
    out = np.empty(n, dtype=U64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


_SYMBOLS = mix(np.arange(1 << 14, dtype=U64) + U64(1))


def _doubled(symbols: np.ndarray) -> np.ndarray:
    """Polynomial hashes of ``KMER`` symbols (a power of two), each from those of the two halves."""
    width, step = 1, int(_STEP)
    while width < KMER:
        symbols = symbols[:-width] * U64(step) + symbols[width:]
        width, step = 2 * width, step * step % (1 << 64)
    return symbols


def items_of(points: np.ndarray) -> np.ndarray:
    """Hashes of a text's occurrence-numbered k-mers in their order; a shorter text is one k-mer."""
    n = len(points)
    if not n:
        return np.zeros(0, U64)
    k = min(KMER, n)
    symbols = _SYMBOLS[points] if points.max() < len(_SYMBOLS) else mix(points.astype(U64) + U64(1))
    if k == KMER:
        grams = _doubled(symbols)
    else:
        grams = np.full(1, U64(k))
        for x in symbols:
            grams = grams * _STEP + x
    grams = mix(grams)
    earlier = _earlier(grams)
    return grams if earlier is None else np.where(earlier == 0, grams, mix(grams + earlier * _STEP))


def least_items(items: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each hash function the least values of the items, and their places counted from ``start``, in the values' order.

    A function multiplies the item's upper (even ones) or lower (odd ones) 32 bits by an odd number."""
    halves = np.ascontiguousarray(items).view(np.uint32).reshape(-1, 2).T.copy()
    values, places = None, None
    every = np.arange(SKETCHES)
    for at in range(0, len(items), BLOCK):
        part = halves[:, at : at + BLOCK]
        own = (_ODD.reshape(-1, 2)[:, :, None] * part[None]).reshape(SKETCHES, -1)
        found, where = np.empty((SKETCHES, PICKED), np.uint32), np.empty((SKETCHES, PICKED), np.int64)
        for j in range(PICKED):
            least = own.argmin(axis=1)
            found[:, j], where[:, j] = own[every, least], least + (at + start)
            own[every, least] = _FULL
        if own.shape[1] < PICKED:
            where[:, own.shape[1] :] = -1
        values, places = (found, where) if values is None else merged(values, places, found, where)
    if values is None:
        return np.full((SKETCHES, PICKED), _FULL), np.full((SKETCHES, PICKED), -1)
    return values, places


def merged(values: np.ndarray, places: np.ndarray, more: np.ndarray, more_places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both, at = np.concatenate([values, more], axis=1), np.concatenate([places, more_places], axis=1)
    order = np.argsort(both, axis=1, kind="stable")[:, :PICKED]
    return np.take_along_axis(both, order, 1), np.take_along_axis(at, order, 1)


def tuple_hashes(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The least items of each hash function in text order, hashed to 32 bits."""
    values = np.take_along_axis(np.where(places < 0, np.uint32(0), values), np.argsort(places, axis=1, kind="stable"), 1)
    out = _SEEDS.copy()
    for j in range(PICKED):
        out = mix(out * _STEP + values[:, j].astype(U64))
    return (out >> U64(32)).astype(np.uint32)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def fingerprint(text: str) -> np.ndarray:
    """``SKETCHES`` hashes of 32 bits; none for the empty text."""
    return tuple_hashes(*least_items(items_of(_points(text)))) if text else np.zeros(0, np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal tuples: 1 for two empty texts, 0 if one is empty."""
    if len(a) != len(b):
        return 0.0
    return float((a == b).mean()) if len(a) else 1.0


def edited_text(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many code points, or all, from the start of ``following``."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _written(marks: np.ndarray) -> str:
    return marks.astype(">u4").tobytes().hex()


class _Own:
    """A text's fingerprint, and the least items of the part that an edit leaves as it is."""

    def __init__(self, text: str):
        self.text = text
        self.kept = max(len(text) - len(text) // 4 - KMER + 1, 0) if len(text) >= KMER else 0
        items = items_of(_points(text))
        self.head = least_items(items[: self.kept])
        self.marks = tuple_hashes(*merged(*self.head, *least_items(items[self.kept :], self.kept))) if text else np.zeros(0, np.uint32)

    def edited(self, text: str) -> np.ndarray:
        """Fingerprint of this text with its last quarter replaced; k-mers before that, and their numbers, are the same."""
        if len(text) < KMER or not self.kept:
            return fingerprint(text)
        return tuple_hashes(*merged(*self.head, *least_items(items_of(_points(text))[self.kept :], self.kept)))


def _report(schema: pa.Schema):
    """Rows sorted by bucket, each bucket closed by the row that follows it, which is not answered for here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []
        for b in batches:
            for doc_id, text, guest in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                own = _Own(text.as_py())
                if last is not None:
                    before, of = last
                    edited = edited_text(of.text, own.text)
                    marks = of.edited(edited)
                    out.append((before, len(of.text), hashlib.sha256(edited.encode()).hexdigest(), _written(of.marks), _written(marks),
                                likeness(of.marks, marks), likeness(of.marks, own.marks)))
                last = None if guest else (doc_id, own)
                if len(out) >= 1000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _dealt(bounds: np.ndarray):
    """Adds ``bucket``: the number of bounds up to the row's id; rows without an id come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            bucket = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
            bucket[ids.is_null().to_numpy(zero_copy_only=False)] = 0
            yield b.append_column("bucket", pa.array(bucket.astype(np.int32)))

    return run


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of each row.

    The edited text ends in the start of the next document's (``edited_text``): next by id,
    null ids first, ties by the text's hash; the first row follows the last. Null texts are
    empty, empty texts have the empty fingerprint; a text of fewer than 8 code points is one
    k-mer. Rows that repeat an id or a text stay rows of their own; ids are read as longs;
    other columns are ignored; an empty table gives an empty result.

    Ids are cut at approximate quantiles into buckets of about ``bucket_bytes`` (at most
    ``MOST_BUCKETS``, then larger ones; rows of one id are not cut). A bucket also gets the
    row that follows it, and is read in order by one task, which holds two texts at a time:
    about 100 bytes of memory a character of the longer one.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = own.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = int(min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, total // bucket_bytes)))
    cuts = own.agg(F.percentile_approx("doc_id", [k / n for k in range(n + 1)], 20 * n), F.count_if(F.col("doc_id").isNull())).first()
    ids = sorted(set(cuts[0] or []))
    starts = [None, *ids[1:]] if cuts[1] else ids or [None]  # the id that each bucket begins with: ids[0] is the least
    bounds = np.array(starts[1:], dtype=np.int64)
    # each bucket's first row closes the bucket before it
    heads = spark.createDataFrame([(s, (k - 1) % len(starts)) for k, s in enumerate(starts)], "head long, bucket int")
    row = F.struct(F.xxhash64("text").alias("h"), "text")
    heads = own.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("bucket").agg(F.min(row).alias("r"))
    heads = heads.select(F.lit(None).cast("long").alias("doc_id"), "r.text", "bucket", F.lit(True).alias("guest"))
    rows = own.mapInArrow(_dealt(bounds), "doc_id long, text string, bucket int").withColumn("guest", F.lit(False))
    dealt = rows.unionByName(heads).repartition(len(starts), "bucket").sortWithinPartitions("bucket", "guest", "doc_id", F.xxhash64("text"))
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("doc_id", "text", "guest").mapInArrow(_report(_arrow(out)), out)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))
