"""Semantic duplicates: cells of bounded size by distributed k-means, and links within a cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.scratch import Scratch, join_small

QUANTUM = 1 << 24
BLOCK = 32


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1)


def _listed(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors; null, empty, zero and non-finite ones, and such with null components, are dropped."""
    for b in batches:
        rows = [(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if i is not None and v and None not in v]
        sound = [(i, np.asarray(v, dtype=np.float64)) for i, v in rows]
        sound = [(i, v / np.linalg.norm(v)) for i, v in sound if np.isfinite(v).all() and v.any()]
        if sound:
            yield pa.record_batch([pa.array([i for i, _ in sound], pa.int64()), pa.array([v.tolist() for _, v in sound], pa.list_(pa.float64()))], ["id", "v"])


def _nearest(centres: np.ndarray, sums: bool):
    """Each vector's nearest centre; with ``sums`` a batch's whole-number sums by centre instead, which add up alike in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column("v"))
            cell = (m @ centres.T).argmax(axis=1)
            if not sums:
                yield b.append_column("cell", pa.array(cell.astype(np.int64)))
                continue
            used, at = np.unique(cell, return_inverse=True)
            total = np.zeros((len(used), m.shape[1]), dtype=np.int64)
            np.add.at(total, at, np.rint(m * QUANTUM).astype(np.int64))
            yield pa.record_batch([pa.array(used), pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * m.shape[1], pa.int32()), pa.array(total.ravel()))], ["cell", "s"])

    return run


def _centres(units: DataFrame, cells: int, rounds: int) -> np.ndarray:
    """At most ``cells`` unit centres of all vectors: seeds by a hash of the id, then Lloyd rounds; the driver holds the centres alone."""
    seeds = units.orderBy(F.xxhash64("id"), "id").limit(cells).collect()
    centres = np.array([r.v for r in seeds], dtype=np.float64)
    for _ in range(rounds if len(centres) else 0):
        parts = units.mapInArrow(_nearest(centres, True), "cell long, s array<long>").select("cell", F.posexplode("s").alias("d", "x"))
        for r in parts.groupBy("cell", "d").agg(F.sum("x").alias("x")).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("s")).collect():
            total = np.array([x.x for x in r.s], dtype=np.float64)
            if total.any():
                centres[r.cell] = total / np.linalg.norm(total)
    return centres


def bounded_cells(vectors: DataFrame, id_col: str, vector_col: str, cells: int = 64, rounds: int = 4, leaf: int = 2048) -> DataFrame:
    """``(id, rep, cell, v)``: unit vectors in cells of at most ``leaf`` distinct ones.

    Equal vectors are one, named by their least id. K-means over all of them gives ``cells``
    first cells; a cell that holds more than ``leaf`` is split again and again, each time by
    the nearer of two of its far members, all such cells in one pass. Vectors that have no
    direction take no part."""
    scratch = Scratch(vectors.sparkSession, "cells")
    units = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(_units, "id long, v array<double>")
    units = scratch.save(units.withColumn("mark", F.md5(F.array_join("v", ","))), "units")
    reps = units.groupBy("mark").agg(F.min("id").alias("rep"))
    own = units.select("mark", "id", "v").join(reps, "mark").where("id = rep").select("id", "v").dropDuplicates(["id"])
    own = scratch.save(own, "reps")
    centres = _centres(own, cells, rounds)
    empty = own.withColumn("cell", F.lit(0).cast("long"))
    placed = scratch.save(own.mapInArrow(_nearest(centres, False), "id long, v array<double>, cell long") if len(centres) else empty, "placed-0")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    k = 0
    while True:
        large = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min_by("v", "id").alias("p")).where(F.col("n") > leaf).select("cell", "p")
        large = scratch.save(large, f"large-{k}")
        if large.isEmpty():
            break
        in_large = join_small(placed, large, ["cell"], 1000, "inner").withColumn("far", F.struct(dot("v", "p"), "id"))
        a = scratch.save(in_large.groupBy("cell").agg(F.min_by("v", "far").alias("a")), f"a-{k}")  # the farthest from some member
        in_large = join_small(placed, a, ["cell"], 1000, "inner").withColumn("far", F.struct(dot("v", "a"), "id"))
        b = in_large.groupBy("cell").agg(F.first("a").alias("a"), F.min_by("v", "far").alias("b"))  # and the farthest from that
        halves = join_small(placed, scratch.save(b, f"b-{k}"), ["cell"], 1000, "left")
        nearer = F.when(F.col("a").isNull(), 0).when(dot("v", "b") > dot("v", "a"), 2).otherwise(1)
        named = F.when(nearer == 0, F.col("cell")).otherwise(F.xxhash64("cell", nearer, F.lit(k)))
        k += 1
        placed = scratch.save(halves.select("id", "v", named.alias("cell")), f"placed-{k}")
    where = placed.select(F.col("id").alias("rep"), "cell")
    return units.join(reps, "mark").join(where, "rep").select("id", "rep", "cell", "v")


def _links(threshold: float):
    """Links between the distinct vectors of a cell, in blocks ordered by distance to the cell's centre: two vectors whose distances to it
    differ by more than any link is long are not compared."""
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def run(key: tuple, cell: pa.Table) -> pa.Table:
        m, rep, n = _matrix(cell.column("v")), cell.column("rep").to_numpy(), cell.column("n").to_numpy()
        centre = m.mean(axis=0)
        far = np.linalg.norm(m - centre, axis=1)
        order = np.lexsort((rep, far))
        m, rep, n, far = m[order], rep[order], n[order], far[order]
        links, compared = n - 1, 0
        for lo in range(0, len(m), BLOCK):
            hi = min(lo + BLOCK, len(m))
            end = int(np.searchsorted(far, far[hi - 1] + reach, side="right"))
            near = m[lo:hi] @ m[lo:end].T > threshold
            near &= np.arange(lo, end)[None, :] > np.arange(lo, hi)[:, None]
            links[lo:hi] += near @ n[lo:end]
            links[lo:end] += n[lo:hi] @ near
            compared += sum(end - i - 1 for i in range(lo, hi))
        every = len(m) * (len(m) - 1) // 2
        size = len(m)
        return pa.table({"cell": cell.column("cell").take(pa.array(order)), "rep": rep, "n_links": links, "cell_size": [size] * size,
                         "compared": [compared] * size, "skipped": [every - compared] * size})

    return run


def semantic_links(cells: DataFrame, threshold: float) -> DataFrame:
    """``(id, rep, cell, n_links, cell_size, compared, skipped)``: for each vector of ``bounded_cells`` the number of others in its
    cell whose cosine with it is above the threshold, copies included, and how many pairs of its cell's distinct vectors were compared and skipped."""
    reps = cells.groupBy("cell", "rep").agg(F.count("*").alias("n"), F.first("v").alias("v"))
    found = reps.select("cell", "rep", "n", "v").groupBy("cell").applyInArrow(_links(threshold), "cell long, rep long, n_links long, cell_size long, compared long, skipped long")
    return cells.select("id", "rep").join(found, "rep").select("id", "rep", "cell", "n_links", "cell_size", "compared", "skipped")
