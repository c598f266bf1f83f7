"""Token counts without token ids.

Texts are cut into pre-tokens as the tokenizer cuts them. A chunk of documents (bounded
in bytes) keeps each document's pre-token frequencies as packed numbers into the chunk's
own list of pre-tokens. The distinct pre-tokens of all chunks are counted by the
tokenizer once each, joined back to the chunks' lists, and a document's count is the sum
of frequency times pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.scratch import Scratch

CHUNK_BYTES = 32 << 20
HELD_COUNTS = 1_000_000
# Fixed value: the byte-level tokenizer's pre-token pattern, with its \s written out as
# the characters of Unicode's White_Space property.
_WS = r"\t-\r \x85\xa0  -     　"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _WS + r"\p{L}\p{N}]+|[" + _WS + r"]+(?![^" + _WS + r"])|[" + _WS + r"]+"
)


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _specials(path: str) -> regex.Pattern | None:
    """Strings that the tokenizer takes as one token each wherever they stand."""
    found = sorted((t.content for t in _tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, found))) if found else None


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers below 2**35, seven bits a byte, the high bit set on all but a number's last."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), dtype=np.int64)
    for k in range(1, 5):
        size += v >= np.uint64(1 << (7 * k))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, dtype=np.uint8)
    for k in range(5):
        own = size > k
        at = (ends - size)[own] + k
        out[at] = ((v[own] >> np.uint64(7 * k)) & np.uint64(127)) | np.where(size[own] > k + 1, 128, 0).astype(np.uint64)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    last = np.flatnonzero(raw < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def pack_frequencies(place: np.ndarray, often: np.ndarray) -> bytes:
    """Rising places with their counts: twice the step to each place, plus 1 if a count
    over 1 is in the list that follows."""
    many = often > 1
    return pack(np.concatenate([[len(place)], np.diff(place, prepend=0) * 2 + many, often[many]]))


def unpack_frequencies(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    v = unpack(data)
    steps, rest = v[1 : v[0] + 1], v[v[0] + 1 :]
    often = np.ones(len(steps), dtype=np.int64)
    often[steps & 1 == 1] = rest
    return np.cumsum(steps >> 1), often


def _frequencies(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, special = regex.compile(PATTERN), _specials(path)
        number, part = 0, TaskContext.get().partitionId()
        ids: dict[str, int] = {}
        docs: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            chunk, n, m = (part << 24) | number, len(docs), len(ids)
            cols = [
                pa.array([chunk] * (n + m), pa.int64()),
                pa.array([d[0] for d in docs] + [None] * m, pa.int64()),
                pa.array([d[1] for d in docs] + [None] * m, pa.int64()),
                pa.array([d[2] for d in docs] + [None] * m, pa.binary()),
                pa.array([None] * n + list(ids.values()), pa.int32()),
                pa.array([None] * n + list(ids), pa.string()),
            ]
            return pa.record_batch(cols, ["chunk", "doc_id", "n_bytes", "packed", "place", "pretoken"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                if special is not None and special.search(text):
                    counts = Counter(special.findall(text))
                    for piece in special.split(text):
                        counts.update(cut.findall(piece))
                else:
                    counts = Counter(cut.findall(text))
                place = np.fromiter((ids.setdefault(t, len(ids)) for t in counts), dtype=np.int64, count=len(counts))
                order = np.argsort(place)
                often = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))[order]
                n_bytes = len(text.encode())
                docs.append((doc_id, n_bytes, pack_frequencies(place[order], often)))
                held += n_bytes
                if held >= CHUNK_BYTES or len(docs) >= 20_000:
                    yield flush()
                    ids, docs, held, number = {}, [], 0, number + 1
        if docs:
            yield flush()

    return run


def _pieces(path: str):
    """Pieces of the pre-tokens of a partition, which holds all rows of each in one run: a
    pre-token is counted once, and only the last one is remembered from batch to batch.
    Results are packed by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        known: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            chunk, place, pieces = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((place, chunk))
            chunk, place, pieces = chunk[order], place[order], pieces[order]
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            parts = [pack_frequencies(place[a:b], pieces[a:b]) for a, b in zip(cuts, cuts[1:])]
            return pa.record_batch([pa.array(chunk[cuts[:-1]]), pa.array(parts, pa.binary())], ["of", "pieces"])

        size = 0
        for b in batches:
            tokens = b.column(2).to_pylist()
            new = [t for t in dict.fromkeys(tokens) if t not in known]
            known |= zip(new, (len(e.ids) for e in tokenizer.encode_batch(new, add_special_tokens=False)))
            pieces = np.fromiter((known[t] for t in tokens), dtype=np.int64, count=len(tokens))
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), pieces))
            known = {tokens[-1]: known[tokens[-1]]} if tokens else known
            size += len(tokens)
            if size >= HELD_COUNTS:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    return run


def _sums(key: tuple, docs: pa.Table, counts: pa.Table) -> pa.Table:
    found = [unpack_frequencies(x) for x in counts.column("pieces").to_pylist()]
    by_place = np.zeros(max((int(p[-1]) + 1 for p, _ in found if len(p)), default=0), dtype=np.int64)
    for place, pieces in found:
        by_place[place] = pieces
    total = []
    for packed in docs.column("packed").to_pylist():
        place, often = unpack_frequencies(packed)
        total.append(int((by_place[place] * often).sum()))
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": docs.column("n_bytes"), "n_tokens": pa.array(total, pa.int64())})


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` for each row, as the byte-level tokenizer file gives them.

    Strings of added tokens inside a text count as that one token. Null and empty texts
    have none. Rows stay separate whatever their id, which must fit a long and may be null
    or repeat; other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    both = scratch.save(
        own.mapInArrow(_frequencies(tokenizer_path), "chunk long, doc_id long, n_bytes long, packed binary, place int, pretoken string"),
        "frequencies",
    )
    listed = both.where("place is not null").select("chunk", "place", "pretoken")
    counted = listed.repartition("pretoken").sortWithinPartitions("pretoken").mapInArrow(_pieces(tokenizer_path), "of long, pieces binary")
    packed = both.where("packed is not null").select("chunk", "doc_id", "n_bytes", "packed")
    return packed.groupBy("chunk").cogroup(counted.groupBy("of")).applyInArrow(_sums, "doc_id long, n_bytes long, n_tokens long")
