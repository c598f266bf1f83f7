"""Token streams: offsets, fixed windows, shards, packing, prompt masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from millrace.plans.scratch import Scratch


def offsets(df: DataFrame, id_col: str, size: str) -> DataFrame:
    """``df`` with ``start``, the sum of ``size`` before it in the order of id, then size.

    Rows are ranged by id into the session's shuffle partitions; a range's own sums and the
    ranges' totals, a row each, replace one sort of everything in a single task."""
    scratch = Scratch(df.sparkSession, "offsets")
    ranged = scratch.save(df.repartitionByRange(id_col).withColumn("_b", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_b").agg(F.sum(size).alias("t")).withColumn("_s", F.coalesce(F.sum("t").over(before), F.lit(0))).select("_b", "_s")
    own = Window.partitionBy("_b").orderBy(id_col, size).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(totals), "_b").withColumn("start", (F.col("_s") + F.coalesce(F.sum(size).over(own), F.lit(0))).cast("long")).drop("_b", "_s")


def fixed_windows(tokens: DataFrame, length: int) -> DataFrame:
    """Tokens ``(pos, token)`` to windows ``(window, input_ids, labels)``: labels are one
    ahead, so a window's last label is the next one's first input. A rest that lacks a label goes."""
    at = F.floor(F.col("pos") / length)
    ahead = tokens.select(F.floor((F.col("pos") - 1) / length).alias("window"), (F.col("pos") - 1).alias("pos"), F.col("token").alias("label")).where("pos >= 0")
    both = tokens.withColumn("window", at).join(ahead, ["window", "pos"])
    listed = both.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "label"))).alias("x")).where(F.size("x") == length)
    return listed.select("window", F.col("x.token").alias("input_ids"), F.col("x.label").alias("labels"))


def shard_pieces(df: DataFrame, size: str, shard_size: int) -> DataFrame:
    """Rows with ``start`` to the pieces that fall in each shard of exactly ``shard_size``
    tokens: ``(id ..., shard, piece_start, piece_size)``; a row may straddle shards."""
    first, last = F.floor(F.col("start") / shard_size), F.floor((F.col("start") + F.col(size) - 1) / shard_size)
    cut = df.where(F.col(size) > 0).withColumn("shard", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start"), F.col("shard") * shard_size)
    high = F.least(F.col("start") + F.col(size), (F.col("shard") + 1) * shard_size)
    return cut.withColumn("piece_start", low - F.col("shard") * shard_size).withColumn("piece_size", high - low)


def response_mask(prompt: Column, response: Column, width: Column, pad: int) -> Column:
    """Struct of padded ``input_ids``, ``labels`` one ahead, and ``mask`` of response labels."""
    whole = F.concat(prompt, response)
    padded = F.concat(whole, F.array_repeat(F.lit(pad), F.greatest(width - F.size(whole), F.lit(0)).cast("int")))
    n = F.size(padded) - 1
    mask = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i >= F.size(prompt) - 1) & (i < F.size(whole) - 1))
    return F.struct(F.slice(padded, F.lit(1), n).alias("input_ids"), F.slice(padded, F.lit(2), n).alias("labels"), mask.alias("mask"))


BLOCK_ITEMS = 1 << 14


def _block_steps(starts: np.ndarray, ends: np.ndarray, capacity: int, last_key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a block of items does to the pack that reaches it, as steps ``(end, last, count)``.

    A pack whose limit is L (its start and the capacity) closes at the first item that ends
    after L; the step with the first ``end`` over L gives the start of the last pack that
    begins in the block, and how many begin from item ``last_key`` on. Only items that start
    within the capacity can be such a first item."""
    n = len(ends)
    at = np.arange(n)
    hop = np.append(np.maximum(np.searchsorted(ends, starts + capacity, side="right"), at + 1), n)
    last, count = np.append(at, n), np.append((at >= last_key).astype(np.int64), 0)
    while (hop < n).any():  # each round doubles the packs that are jumped at once
        on = hop < n
        count = count + np.where(on, count[hop], 0)
        last, hop = np.where(on, last[hop], last), np.where(on, hop[hop], hop)
    first = min(int(np.searchsorted(starts, capacity, side="right")) + 1, n)  # and one that a gap may put beyond
    last, count = starts[last[:first]], count[:first]
    cut = np.append(np.flatnonzero((np.diff(last) != 0) | (np.diff(count) != 0)), first - 1)
    return ends[:first][cut], last[cut], count[cut]


def _in_blocks(key: str | None, size: str, capacity: int, block_items: int):
    """Sorted rows with ``_block``, ``_start`` and ``_end``, and a row with the steps of each block.

    Places count from the block's start. A gap wider than the capacity stands before each
    new key, so that no pack reaches over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for lo in range(0, whole.num_rows, block_items):
                b = whole.slice(lo, block_items)
                n = b.num_rows
                sizes = b.column(size).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                new = np.zeros(n, dtype=bool)
                if key is not None:
                    new[1:] = np.diff(b.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()) != 0
                gaps = np.cumsum(new) * (capacity + 1)
                ends = np.cumsum(sizes) + gaps
                starts = ends - sizes
                last_key = int(np.flatnonzero(new)[-1]) if new.any() else 0
                steps = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in _block_steps(starts, ends, capacity, last_key)]
                names = [*b.schema.names, "_block", "_start", "_end", "_new", "_steps_end", "_steps_last", "_steps_count"]
                none = [pa.nulls(n, pa.list_(pa.int64()))] * 3
                yield pa.record_batch([*b.columns, pa.array(np.full(n, block)), pa.array(starts), pa.array(ends), pa.array(new), *none], names)
                one = [b.column(key).slice(k, 1) if f.name == key else pa.nulls(1, f.type) for k in (0, n - 1) for f in b.schema]
                own = [pa.array([block]), pa.array([0]), pa.array([int(ends[-1])]), pa.array([bool(new.any())])]
                for k, cols in enumerate((one[: len(one) // 2], one[len(one) // 2 :])):  # its first key, then its last
                    yield pa.record_batch([*cols, own[0], pa.array([k]), *own[2:], *steps], names)
                block += 1

    return run


def _chained(capacity: int):
    """Blocks in their order, two rows each: the limit that reaches each, and the packs that its first key has begun before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, limit, packs = None, -1, 0
        for b in batches:
            out = []
            for i, r in enumerate(b.select(["_block", "_start", "_end", "_new"]).to_pylist()):
                key = b.column("_key").slice(i, 1)
                if r["_start"] == 1:
                    owner = key
                    continue
                if owner is None or not key.equals(owner):
                    limit, packs = -1, 0
                out.append((r["_block"], limit, packs))
                ends, last, count = (b.column(c)[i].values.to_numpy() for c in ("_steps_end", "_steps_last", "_steps_count"))
                step = int(np.searchsorted(ends, limit, side="right"))
                if step < len(ends):
                    limit, packs = int(last[step]) + capacity, (0 if r["_new"] else packs) + int(count[step])
                limit -= r["_end"]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["_block", "_limit", "_packs"])

    return run


def _numbered(order: str, size: str, capacity: int):
    def run(key: tuple, rows: pa.Table, entry: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("_start", "ascending"), ("_new", "descending"), (order, "ascending"), (size, "ascending")], null_placement="at_start"))
        starts, ends, new = (rows.column(c).to_numpy() for c in ("_start", "_end", "_new"))
        begun = np.zeros(len(starts), dtype=np.int64)
        at = int(np.searchsorted(ends, entry.column("_limit")[0].as_py(), side="right"))
        while at < len(starts):
            begun[at] = 1
            at = max(int(np.searchsorted(ends, starts[at] + capacity, side="right")), at + 1)
        total = np.cumsum(begun)
        base = np.maximum.accumulate(np.where(new, total - 1, -1))  # packs begun before the row's key
        pack = np.where(base < 0, entry.column("_packs")[0].as_py() + total, total - base) - 1
        return rows.append_column("pack", pa.array(pack)).drop_columns(["_block", "_start", "_end", "_new"])

    return run


def ordered_runs(df: DataFrame, order: str, size: str, capacity: int, key: str | None = None, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``df`` with ``pack`` (from 0): items in their order, a pack closing when the next item would exceed
    ``capacity``; one stream for each ``key``, or one of all rows. An item over the capacity is a pack of its own.

    Where a pack closes depends only on where it starts, so the sorted stream is cut into
    blocks of at most ``block_items`` items, and each block is reduced to a step function
    from the limit of the pack that reaches it to the start of the last pack in it:
    successors are jumped by doubling within a block, the blocks' functions are chained, and
    the blocks then number their own items. No task holds more than a block's items, whatever
    a key's; the chain reads two rows a block, each with at most as many steps as one pack has items.

    Sizes are whole and not negative, null counts as 0; items of equal order go by size.
    Other columns stay; an empty table gives an empty result."""
    scratch = Scratch(df.sparkSession, "runs")
    by = [c for c in (key, order, size) if c is not None]
    plain = df.withColumn(size, F.col(size).cast("long"))
    extra = "_block long, _start long, _end long, _new boolean, _steps_end array<long>, _steps_last array<long>, _steps_count array<long>"
    named = [T.StructField(f.name, f.dataType) for f in plain.schema]
    ranged = plain.repartitionByRange(*by).sortWithinPartitions(*by)
    both = scratch.save(ranged.mapInArrow(_in_blocks(key, size, capacity, block_items), T.StructType([*named, *T.StructType.fromDDL(extra)])), "blocks")
    blocks = both.where("_steps_end is not null").select((F.col(key) if key else F.lit(0)).alias("_key"), *[c.strip().split(" ")[0] for c in extra.split(",")])
    entries = blocks.repartition(1).sortWithinPartitions("_block", "_start").mapInArrow(_chained(capacity), "_block long, _limit long, _packs long")
    items = both.where("_steps_end is null").drop("_steps_end", "_steps_last", "_steps_count")
    out = T.StructType([*named, T.StructField("pack", T.LongType())])
    return items.groupBy("_block").cogroup(entries.groupBy("_block")).applyInArrow(_numbered(order, size, capacity), out)


def greedy_packs(df: DataFrame, key: str, order: str, size: str, capacity: int) -> DataFrame:
    """Within each ``key``, items in order; a pack closes when the next would exceed it."""
    return ordered_runs(df, order, size, capacity, key).select(key, order, "pack")
