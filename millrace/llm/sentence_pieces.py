"""SentencePiece encoding and decoding as weighted finite-state transduction.

A model compiles to three machines: a normaliser (the model's character map, white space,
dummy prefix), an acceptor of the vocabulary's pieces as a trie, and arcs for characters
without a piece (byte fallback, or the unknown piece). Composed with an input they give a
lattice of pieces, whose shortest path in the tropical semiring is the encoding.

In a unigram model an arc weighs its piece's negative score. In a byte-pair model a
segmentation is the model's own exactly if every two neighbouring pieces are: merging
their joined text alone gives the two again. So there an arc weighs 0 if the piece may
follow the one before it and is infinite if not; as no path weighs less than 0, a
best-first search that prefers long pieces may stop at the first path it completes.

If no piece spans a line feed, nor a U+2581 after another character, the lattice falls
apart at these places and the parts are solved, and remembered, alone.
"""

from __future__ import annotations

import gc
import re
import struct
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
CACHE_ENTRIES = 200_000  # in each of two generations
BATCH_ROWS = 512
_UNITS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
# Fixed values of the model format
UNIGRAM, BYTE_PAIR = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNKNOWN_PENALTY = 10.0


def character_map(blob: bytes) -> dict[str, str]:
    """The rewrites of a compiled character map: a double-array trie, whose leaves point to
    the texts that follow it."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = np.frombuffer(blob, "<u4", size // 4, 4)
    texts = blob[4 + size :]
    labels = units & np.uint32(0x800000FF)
    every = np.arange(1, 256, dtype=np.int64)
    out, todo = {}, [(0, b"")]
    while todo:
        at, key = todo.pop()
        unit = int(units[at])
        base = at ^ (unit >> 10 << ((unit & 0x200) >> 6))
        if unit & 0x100:
            begin = int(units[base]) & 0x7FFFFFFF
            out[key.decode()] = texts[begin : texts.index(b"\0", begin)].decode()
        to = base ^ every
        inside = np.minimum(to, len(units) - 1)
        for i in np.flatnonzero((labels[inside] == every) & (to == inside)):
            todo.append((int(to[i]), key + bytes([int(every[i])])))
    return out


class Normaliser:
    """The machine that rewrites an input before pieces are looked for."""

    def __init__(self, spec):
        if not spec.escape_whitespaces:
            raise ValueError("models that keep blanks are not compiled")
        self.map = character_map(spec.precompiled_charsmap)
        lengths: dict[str, set[int]] = {}
        for key in self.map:
            lengths.setdefault(key[0], set()).add(len(key))
        self.lengths = {c: sorted(n, reverse=True) for c, n in lengths.items()}
        self.starts = re.compile("[" + "".join(map(re.escape, lengths)) + "]") if lengths else None
        self.squeeze = spec.remove_extra_whitespaces
        self.prefix = SPACE if spec.add_dummy_prefix else ""

    def rewrite(self, text: str) -> str:
        """The longest match of the map at each place is replaced, from the left."""
        out, at = [], 0
        for m in self.starts.finditer(text) if self.starts else ():
            i = m.start()
            for n in self.lengths[text[i]] if i >= at else ():
                new = self.map.get(text[i : i + n])
                if new is not None:
                    out += [text[at:i], new]
                    at = i + n
                    break
        return "".join([*out, text[at:]]) if out else text

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        text = self.rewrite(text)
        if not self.squeeze:
            return self.prefix + text.replace(" ", SPACE)
        text = re.sub(" +", " ", text.strip(" "))
        return (self.prefix + text.replace(" ", SPACE)).rstrip(SPACE)


class PieceTransducer:
    """The compiled machines of one model file of the byte-pair or the unigram kind."""

    def __init__(self, model):
        self.kind = model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BYTE_PAIR) or any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("only byte-pair and unigram models without user-defined symbols are compiled")
        if model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with white space at the end of pieces are not compiled")
        self.normalise = Normaliser(model.normalizer_spec)
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.rank = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.fallback = len(bytes_) == 256
        self.bytes = [bytes_[b] for b in range(256)] if self.fallback else []
        self.cost = [-p.score for p in model.pieces]
        self.unknown_cost = UNKNOWN_PENALTY - min(self.rank.values(), default=0.0)
        self.whole = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids)  # inputs cannot be cut then
        surface = model.trainer_spec.unk_surface
        named = {UNKNOWN: surface, CONTROL: ""}
        self.spelled = [named.get(p.type, p.piece.replace(SPACE, " ")).encode() for p in model.pieces]
        for b, i in bytes_.items():
            self.spelled[i] = bytes([b])
        self.trie: dict = {}  # by character: the next node, and the piece that ends there
        for piece, i in self.ids.items():
            node, step = self.trie, None
            for ch in piece:
                step = node.setdefault(ch, [{}, -1, ()])
                node = step[0]
            if step:
                step[1:] = i, (i,)
        self.follows: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> PieceTransducer:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        return cls(model)

    def merged(self, text: str) -> list[str]:
        """Segmentation by merging, best score first, then leftmost; defines the arcs' weights."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.follows.get(key)
        if known is None:
            x, y = self.pieces[a], self.pieces[b]
            known = self.follows[key] = self.merged(x + y) == [x, y]
        return known

    def shortest_path(self, unit: str) -> list[int] | None:
        """Ids on the path of least weight through the lattice of one unit; None if all are infinite."""
        return self._least_sum(unit) if self.kind == UNIGRAM else self._weightless(unit)

    def _least_sum(self, unit: str) -> list[int]:
        """Places in order are a topological order of the lattice; of equal sums the longer last piece wins."""
        n = len(unit)
        least: list[float] = [0.0, *[float("inf")] * n]
        last: list[tuple[int, tuple[int, ...]]] = [(0, ())] * (n + 1)
        for at in range(n):
            for end, piece, ids in self._arcs(unit, at):
                weight = least[at] + (self.unknown_cost if piece < 0 else self.cost[piece])
                if weight < least[end]:
                    least[end], last[end] = weight, (at, ids)
        path: list[tuple[int, ...]] = []
        while n:
            n, ids = last[n]
            path.append(ids)
        return [i for ids in reversed(path) for i in ids]

    def _weightless(self, unit: str) -> list[int] | None:
        n = len(unit)
        dead: set[tuple[int, int]] = set()
        follows, arcs_at = self.follows, self._arcs
        # an entry: position, piece before (-1: none, bytes or unknown), arcs still to try
        stack = [(0, -1, arcs_at(unit, 0))]
        out: list[tuple[int, ...]] = []
        while stack:
            at, before, arcs = stack[-1]
            if at == n:
                return [i for step in out for i in step]
            while arcs:
                end, after, ids = arcs.pop()
                if dead and (end, after) in dead:
                    continue
                if before >= 0 and after >= 0:
                    may = follows.get(before << 20 | after)
                    if not (self._may_follow(before, after) if may is None else may):
                        continue
                out.append(ids)
                stack.append((end, after, arcs_at(unit, end) if end < n else arcs))
                break
            else:
                dead.add((at, before))
                stack.pop()
                if out:
                    out.pop()
        return None

    def _arcs(self, unit: str, at: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """Arcs of the lattice that leave a position - end, piece (-1: none), ids -, the longest piece last."""
        found, node, i = [], self.trie, at
        for ch in unit[at:]:
            step = node.get(ch)
            if step is None:
                break
            i += 1
            node, piece, ids = step
            if piece >= 0:
                found.append((i, piece, ids))
        if at < len(unit) and (not found or found[0][0] != at + 1):  # the character has no piece
            found.insert(0, (at + 1, -1, tuple(self.bytes[b] for b in unit[at].encode("utf-8", "replace")) if self.fallback else (self.unknown,)))
        return found

    def unit_ids(self, unit: str) -> bytes:
        """Ids of a unit that the younger generation of remembered units lacks."""
        ids = self.old.get(unit)
        if ids is None:
            path = self.shortest_path(unit)
            if path is None:
                raise ValueError("the lattice has no path of weight 0")
            ids = array("i", path).tobytes()
        if len(unit) <= 64:
            if len(self.known) >= CACHE_ENTRIES:
                self.known, self.old = {}, self.known
            self.known[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text, as 32-bit numbers in native order."""
        text = self.normalise(text)
        if not text:
            return b""
        known, solve = self.known, self.unit_ids  # a text may fill the generation; the rest of it then looks there last
        ids = b"".join([known.get(u) or solve(u) for u in ([text] if self.whole else _UNITS.findall(text))])
        return ids if self.fallback else self._one_unknown(ids)

    def _one_unknown(self, ids: bytes) -> bytes:
        """Neighbouring unknown characters are one unknown piece."""
        x = np.frombuffer(ids, np.int32)
        keep = np.ones(len(x), dtype=bool)
        keep[1:] = (x[1:] != self.unknown) | (x[:-1] != self.unknown)
        return x[keep].tobytes()

    def decode(self, ids) -> str:
        """Text of some ids: spelled pieces, invalid bytes replaced, without the blanks that normalising puts or drops in front."""
        spelled, at, lead = self.spelled, 0, b""
        while at < len(ids) and (self.normalise.squeeze or self.normalise.prefix):
            if ids[at] == self.unknown:
                break
            lead = spelled[ids[at]]
            at += 1
            if self.normalise.squeeze:
                lead = lead.lstrip(b" ")
            elif lead[:1] == b" ":
                lead = lead[1:]
                break
            if lead:
                break
        return b"".join([lead, *[spelled[i] for i in ids[at:]]]).decode("utf-8", "replace")


@cache
def transducer(path: str) -> PieceTransducer:
    return PieceTransducer.load(path)


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without the collector of cycles: encoding makes none, but many short-lived objects that it would look through."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(at, BATCH_ROWS)


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text_col``, without begin or end ids.

    Null gives null, an empty text an empty array. Rows are encoded alone; an existing
    ``out_col`` is replaced; an empty table gives an empty result.
    """
    own = docs.drop(out_col)
    at = own.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path)
        for b in _small(batches):
            rows, ends, size, nulls = [], [0], 0, []
            for t in b.column(at):
                t = t.as_py()
                nulls.append(t is None)
                ids = machine.encode(t) if t else b""
                rows.append(ids)
                size += len(ids) // 4
                ends.append(size)
            flat = pa.array(np.frombuffer(b"".join(rows), dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array(nulls))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, out_col])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def decode_pieces(docs: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids_col``; null gives null, no ids an empty text; an existing
    ``out_col`` is replaced; an empty table gives an empty result."""
    own = docs.drop(out_col)
    at = own.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path)
        for b in _small(batches):
            texts = [None if not ids.is_valid else machine.decode(ids.values.to_numpy().tolist()) for ids in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(out_col, T.StringType())]))


def piece_report(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, ids, n_pieces, round_trip)`` for each row of ``docs``.

    ``round_trip`` tells whether decoding gives the text back; U+2581, which encodes like a
    blank, counts as one. A null text has null ids, no pieces, and comes back as empty;
    repeated rows and null ids are answered as they come; an empty table gives an empty result.
    """
    own = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path)
        for b in _small(batches):
            rows, same = [], []
            with _uncollected():
                for t in b.column(1).to_pylist():
                    ids = machine.encode(t) if t else b""
                    rows.append(ids)
                    same.append(machine.decode(np.frombuffer(ids, np.int32).tolist()) == (t or "").replace(SPACE, " "))
            n = np.array([len(x) // 4 for x in rows], dtype=np.int64)
            ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)), mask=b.column(1).is_null())
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(n), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_pieces", "round_trip"])

    found = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return own.mapInArrow(run, T.StructType([own.schema["doc_id"], *found]))
