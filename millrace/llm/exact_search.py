"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are packed into blocks with the statistics of their segments; each query block
meets each candidate block once. The box around a candidate block's coarse statistics
tells whether any query can find something in it. For the rest, means and deviations of
segments give lower bounds of the squared distances: coarse segments first, finer ones
for what is left, and the exact distances of the survivors last. The inner product follows
from the distance, as (|q|^2 + |c|^2 - d^2) / 2, so a query's k-th best score so far is a
distance limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.plans.scratch import Scratch

QUERY_BLOCK = 512
BLOCK = 4096
SEGMENTS = (4, 16)
EXACT = float(1 << 53)


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as double; null for a vector that is null or
    holds a null or a non-finite component. Beyond the range of long, values saturate."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


class Block:
    """Some vectors as rows of a matrix, with their ids and the statistics of each resolution."""

    COLUMNS = (("block", pa.int64()), ("ids", pa.binary()), ("width", pa.int32()), ("kind", pa.string()), ("matrix", pa.binary()), ("stats", pa.binary()))
    SCHEMA = "block long, ids binary, width int, kind string, matrix binary, stats binary"

    def __init__(self, number: int, ids: np.ndarray, matrix: np.ndarray, stats: list[np.ndarray]):
        self.number, self.ids, self.matrix, self.stats = number, ids, matrix, stats

    @classmethod
    def of(cls, number: int, ids: list[int], vectors: list[np.ndarray]) -> Block:
        matrix = np.zeros((len(vectors), max(map(len, vectors))), dtype=np.int64)
        for i, v in enumerate(vectors):
            matrix[i, : len(v)] = v
        return cls(number, np.array(ids, dtype=np.int64), matrix, [segment_statistics(matrix, s) for s in levels(matrix.shape[1])])

    def row(self) -> list:
        low, high = value_range(self.matrix)
        kind = next(k for k in ("i1", "i2", "i4", "i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
        stats = np.concatenate([s.ravel() for s in self.stats]) if self.stats else np.zeros(0)
        return [self.number, self.ids.tobytes(), self.matrix.shape[1], kind, self.matrix.astype(kind).tobytes(), stats.tobytes()]

    @classmethod
    def read(cls, r: dict, prefix: str = "") -> Block:
        ids, width = np.frombuffer(r[f"{prefix}ids"], np.int64), r[f"{prefix}width"]
        matrix = np.frombuffer(r[f"{prefix}matrix"], r[f"{prefix}kind"]).reshape(len(ids), width).astype(np.int64)
        flat, stats = np.frombuffer(r[f"{prefix}stats"]), []
        for s in levels(width):
            stats.append(flat[: 2 * s * len(ids)].reshape(len(ids), 2 * s))
            flat = flat[2 * s * len(ids) :]
        return cls(r[f"{prefix}block"], ids, matrix, stats)


def value_range(m: np.ndarray) -> tuple[int, int]:
    return (int(m.min()), int(m.max())) if m.size else (0, 0)


def largest(m: np.ndarray) -> int:
    low, high = value_range(m)
    return max(-low, high)


def levels(width: int) -> list[int]:
    return [s for s in SEGMENTS if s < width]


def _pack(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, vectors = TaskContext.get().partitionId(), 0, [], []

        def block() -> pa.RecordBatch:
            row = Block.of(part << 24 | number, ids, vectors).row()
            return pa.record_batch([pa.array([x], t) for x, (_, t) in zip(row, Block.COLUMNS)], [c for c, _ in Block.COLUMNS])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                vectors.append(v.values.to_numpy(zero_copy_only=False))
                if len(ids) == rows:
                    yield block()
                    ids, vectors, number = [], [], number + 1
        if ids:
            yield block()

    return run


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def segment_statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations of a row's segments: the squared distance of two rows
    of these is never above that of the rows themselves."""
    width = m.shape[1]
    size = -(-width // segments)
    x = np.pad(m.astype(np.float64), ((0, 0), (0, size * segments - width))).reshape(len(m), segments, size)
    mean = x.mean(axis=2)
    return np.concatenate([mean * np.sqrt(size), np.sqrt(((x - mean[:, :, None]) ** 2).sum(axis=2))], axis=1)


def _exact_scores(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Integer inner products of some pairs; beyond the range of long they saturate."""
    top = largest(q) * largest(c) * max(q.shape[1], 1)
    if top >= 1 << 62:
        big = [sum(int(x) * int(y) for x, y in zip(q[i].tolist(), c[j].tolist())) for i, j in zip(rows, cols)]
        return np.array([max(-(2**63), min(2**63 - 1, s)) for s in big], dtype=np.int64)
    if top < EXACT and len(rows) * 4 > len(q) * len(c):
        return (q.astype(np.float64) @ c.astype(np.float64).T)[rows, cols].astype(np.int64)
    out = np.empty(len(rows), dtype=np.int64)
    for a in range(0, len(rows), 65536):
        part = slice(a, a + 65536)
        out[part] = np.einsum("ij,ij->i", q[rows[part]], c[cols[part]])
    return out


def in_reach(q: Block, c: Block, limit: np.ndarray) -> bool:
    """Whether a row of ``c`` may score a query's ``limit``, by the box of the coarse statistics."""
    if not q.stats or not c.stats or q.matrix.shape[1] != c.matrix.shape[1]:
        return True
    own, other = q.stats[0], c.stats[0]
    away = np.maximum(np.maximum(other.min(axis=0) - own, own - other.max(axis=0)), 0)
    top = (q.matrix.astype(np.float64) ** 2).sum(axis=1) + (c.matrix.astype(np.float64) ** 2).sum(axis=1).max() - (away**2).sum(axis=1)
    return bool((top / 2 + 0.5 >= limit).any())


def block_top_k(asked: Block, held: Block, k: int, floor: np.ndarray | None = None, step: int = 1024):
    """Arrays (query row, candidate row, score) that hold at least each query's ``k`` best of a block.

    ``floor`` has scores that a query's k-th best over all blocks is known to reach.
    Candidates with the query's own id are none.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = max(asked.matrix.shape[1], held.matrix.shape[1])
    q, c, q_ids, c_ids = _widened(asked.matrix, width), _widened(held.matrix, width), asked.ids, held.ids
    safe = largest(q) * largest(c) * max(width, 1) < EXACT
    limit = np.full(len(q), -np.inf) if floor is None else floor.astype(np.float64)
    if safe and not in_reach(asked, held, limit):
        return none
    own, other = ([b.stats if b.matrix.shape[1] == width else [segment_statistics(m, s) for s in levels(width)] for b, m in ((asked, q), (held, c))])
    q2 = (q.astype(np.float64) ** 2).sum(axis=1)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    best = np.full((len(q), 0), -np.inf)
    for a in range(0, len(c), step):
        part = c[a : a + step]
        c2 = (part.astype(np.float64) ** 2).sum(axis=1)
        open_ = q_ids[:, None] != c_ids[None, a : a + step]
        if safe:
            farthest = q2[:, None] + c2[None, :] - 2 * limit[:, None]
            for x, y in zip(own, other):
                cols = np.flatnonzero(open_.any(axis=0))
                if not len(cols):
                    break
                y = y[a : a + step][cols]
                bound = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * x @ y.T
                # rounding of the bounds is far below half a unit of the integer scores
                open_[:, cols] &= bound <= farthest[:, cols] + 0.5
        rows, cols = np.nonzero(open_)
        if not len(rows):
            continue
        score = _exact_scores(q, part, rows, cols)
        good = score >= limit[rows]
        rows, cols, score = rows[good], cols[good], score[good]
        kept.append((rows, cols + a, score))
        grid = np.full((len(q), len(part)), -np.inf)
        grid[rows, cols] = score
        both = np.concatenate([best, grid], axis=1)
        best = -np.partition(-both, min(k, both.shape[1]) - 1, axis=1)[:, :k]
        if best.shape[1] == k:
            limit = np.maximum(limit, best.min(axis=1))
    if not kept:
        return none
    rows, cols, score = (np.concatenate(x) for x in zip(*kept))
    good = score >= limit[rows]
    rows, cols, score = rows[good], cols[good], score[good]
    # of a block's ties at the limit, only the least ids can be in the result
    order = np.lexsort((c_ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    first = nth < k
    return rows[first], cols[first], score[first]


_ASKED = [f"q_{c}" for c, _ in Block.COLUMNS]


def _score_blocks(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                asked, held = Block.read(r, "q_"), Block.read(r)
                rows, cols, score = block_top_k(asked, held, k, np.frombuffer(r["floors"], np.float64))
                number = asked.number * QUERY_BLOCK + rows  # tells askers that share an id apart
                yield pa.record_batch([pa.array(x) for x in (number, asked.ids[rows], held.ids[cols], score)], ["asker", "query_id", "vec_id", "score"])

    return run


def _floors(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                asked = Block.read(r, "q_")
                rows, _, score = block_top_k(asked, Block.read(r), k)
                out, found = np.full(len(asked.ids), np.inf), np.bincount(rows, minlength=len(asked.ids))
                np.minimum.at(out, rows, score.astype(np.float64))
                out[found < k] = -np.inf
                cols = [pa.array([r[c]], t) for c, (_, t) in zip(_ASKED, Block.COLUMNS)]
                yield pa.record_batch([*cols, pa.array([out.tobytes()], pa.binary())], [*_ASKED, "floors"])

    return run


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` largest inner products.

    Both tables are ``(id long, v array<long>)``; ties go to the smaller id, rows of a
    query's own id are no candidates, and a query with fewer candidates gets them all. Null
    ids or vectors take no part. Vectors of unequal length are compared as if the shorter
    ended in zeros, so an empty one scores 0 everywhere; scores beyond the range of long
    saturate. Candidates that repeat an id are each a candidate; equal query rows ask once,
    unequal ones of one id each ask for themselves. An empty side gives no rows.
    """
    scratch = Scratch(queries.sparkSession, "search")
    whole = lambda x: x.select("id", "v").where("id is not null and v is not null")
    blocks = scratch.save(whole(candidates).mapInArrow(_pack(BLOCK), Block.SCHEMA), "candidates")
    asked = whole(queries).dropDuplicates(["id", "v"]).mapInArrow(_pack(QUERY_BLOCK), Block.SCHEMA).toDF(*_ASKED)
    # one block of candidates gives every query a first limit
    seed = blocks.join(F.broadcast(blocks.agg(F.min("block").alias("block"))), "block")
    schema = ", ".join(f"q_{c}" for c in Block.SCHEMA.split(", ")) + ", floors binary"
    asked = scratch.save(asked.crossJoin(F.broadcast(seed)).mapInArrow(_floors(k), schema), "queries")
    met = asked.crossJoin(blocks)  # rows are whole blocks on both sides
    best = met.mapInArrow(_score_blocks(k), "asker long, query_id long, vec_id long, score long")
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_report(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Top-k of the rows whose id is divisible by ``every`` among all other rows."""
    whole = vectors.select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("v"))
    return exact_top_k(whole.where(F.col("id") % every == 0), whole, k)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 20
"""
