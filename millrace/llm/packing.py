"""Conflict-constrained best-fit packing of documents into fixed-size sequences.

1. Rows are dealt to windows by a hash of the row, so every window has the table's mix of
   sources and sizes whatever the stored order, and is packed best-fit.
2. Bins left open are dealt anew, by a hash that differs each round, and packed best-fit as
   items themselves. Rounds end when one window holds all open bins that can still take
   something, or when a round joins none.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._expr import let
from millrace.plans.scratch import Scratch

WINDOW_ITEMS = 4096


def best_fit(items: list[tuple[int, str | None, int | None]], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each item ``(size <= capacity, source, cluster)``.

    A null source or cluster conflicts with nothing.
    """
    some = lambda x: () if x is None else (x,)
    return best_fit_groups([(n, some(s), some(c)) for n, s, c in items], capacity)


def best_fit_groups(items: list[tuple[int, tuple, tuple]], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each item ``(size <= capacity, sources, clusters)``.

    Items go in by falling size. Open bins are ordered by residual capacity and carry a
    bitmap of their sources and one of their duplicate clusters; the successor search
    starts at the least residual that fits and goes on to the tightest bin that holds
    none of the item's sources and clusters.
    """
    places: dict[str, int] = {}
    often = Counter(c for _, _, cs in items for c in set(cs))
    clusters = {c: i for i, c in enumerate(c for c, n in often.items() if n > 1)}  # others cannot conflict
    open_: list[tuple[int, int]] = []
    held: list[list[int]] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(items)
    for at in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        size, own, copies = items[at]
        s = c = 0
        for x in own:
            s |= 1 << places.setdefault(x, len(places))
        for x in copies:
            c |= 1 << clusters[x] if x in clusters else 0
        k = bisect_left(open_, (size, -1))
        while k < len(open_) and (held[open_[k][1]][0] & s or held[open_[k][1]][1] & c):
            k += 1
        if k < len(open_):
            residual, bin_ = open_.pop(k)
        else:
            residual, bin_ = capacity, len(held)
            held.append([0, 0])
        held[bin_][0] |= s
        held[bin_][1] |= c
        out[at] = (bin_, capacity - residual)
        if residual > size:
            insort(open_, (residual - size, bin_))
    return out


def _by_window(df: DataFrame, windows: int, order: str) -> DataFrame:
    spark = df.sparkSession
    parts = min(windows, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return df.repartition(parts, "window").sortWithinPartitions("window", order)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple]]]:
    """``(window, cut, rows)`` of batches sorted by their last column, the window.

    Only a heap of equal rows makes a window much longer than ``WINDOW_ITEMS``; it is cut,
    so that memory is bounded, and left to the rounds."""
    rows, now, cut = [], None, 0
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if rows and (row[-1] != now or len(rows) == 4 * WINDOW_ITEMS):
                yield now, cut, rows
                rows, cut = [], cut + 1 if row[-1] == now else 0
            now = row[-1]
            rows.append(row[:-1])
    if rows:
        yield now, cut, rows


def _join_open_bins(placed: DataFrame, capacity: int, scratch: Scratch) -> DataFrame | None:
    """``(bin_id, into, shift)`` for each bin of ``placed`` that goes into another; None if there is none."""
    now = placed.groupBy("bin_id").agg(F.sum("size").alias("fill"), F.collect_set("source").alias("sources"), F.collect_set("cluster").alias("clusters"))
    now, moved = scratch.save(now.where(F.col("fill") < capacity), "open-0"), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows in _windows(batches):
            at = best_fit_groups([(fill, tuple(s), tuple(c)) for _, fill, s, c in rows], capacity)
            first = {bin_: rows[i][0] for i, (bin_, offset) in reversed(list(enumerate(at))) if offset == 0}
            cols = [*zip(*rows)]
            types = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
            arrays = [pa.array(c, t) for c, t in zip(cols, types)]
            arrays += [pa.array([first[b] for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())]
            yield pa.record_batch(arrays, ["bin_id", "fill", "sources", "clusters", "into", "shift"])

    for k in count(1):
        least = now.agg(F.min("fill")).first()[0]
        able = now.where(F.col("fill") + F.lit(least) <= capacity) if least is not None else now
        n = able.count()
        if n < 2:
            break
        windows = -(-n // WINDOW_ITEMS)
        dealt = able.withColumn("window", F.pmod(F.xxhash64("bin_id", F.lit(k)), F.lit(windows)))
        joined = _by_window(dealt, windows, "bin_id").mapInArrow(
            run, "bin_id long, fill long, sources array<string>, clusters array<long>, into long, shift long"
        )
        joined = scratch.save(joined, f"round-{k}")
        scratch.drop(f"open-{k - 1}")
        step = joined.where("bin_id <> into").select("bin_id", "into", "shift")
        if step.isEmpty():
            break
        if moved is not None:
            on = step.select(F.col("bin_id").alias("into"), F.col("into").alias("last"), F.col("shift").alias("more"))
            moved = moved.join(on, "into", "left").select("bin_id", F.coalesce("last", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            step = moved.unionByName(step)
        moved = scratch.save(step, f"moved-{k}")
        if windows == 1:
            break
        now = joined.groupBy(F.col("into").alias("bin_id")).agg(
            F.sum("fill").alias("fill"), F.flatten(F.collect_list("sources")).alias("sources"), F.flatten(F.collect_list("clusters")).alias("clusters")
        )
        now = scratch.save(now.where(F.col("fill") < capacity), f"open-{k}")
    return moved


def piece_starts(raw: Column, n: Column, capacity: int) -> Column:
    """Byte places where the pieces of a UTF-8 text of ``n > capacity`` bytes begin.

    A grid three bytes finer than the capacity, each place moved back to the code point that
    it falls into: no piece is longer than the capacity, none begins inside a code point."""
    inner = lambda at: F.hex(F.substring(raw, at + 1, F.lit(1))).between("80", "BF")
    back = lambda at: F.when(~inner(at), at).when(~inner(at - 1), at - 1).when(~inner(at - 2), at - 2).otherwise(at - 3)
    step = capacity - 3
    return F.transform(F.sequence(F.lit(0), F.ceil(n / step).cast("int") - 1), lambda i: F.when(i == 0, F.lit(0)).otherwise(back((i * step).cast("int"))))


def pack_documents(
    docs: DataFrame, capacity: int = 8192, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``(doc_id, piece, start, size, bin_id, bin_offset)``: a row for each piece of each document.

    Sizes are UTF-8 bytes; ``capacity`` is at least 8. A text longer than ``capacity`` is cut
    between code points: all its pieces but the last have bins of their own, and the last is
    packed like any other text; ``start`` is the piece's byte in the text. A bin never holds two texts of one source, nor two equal texts.
    A null or empty text is one piece of size 0. Rows meet in windows of about
    ``WINDOW_ITEMS``, dealt by a hash of the row, and open bins in further rounds: memory
    is bounded by the window, neither a hot source nor a hot group of copies meets in one
    task, and the result does not depend on files or partitions. Bin ids are unique over
    the table. Repeated rows and null ids are packed as they come, other columns are
    ignored, an empty table gives an empty result.
    """
    if capacity < 8:
        raise ValueError("capacity is below 8 bytes")
    scratch = Scratch(docs.sparkSession, "packing")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n"), F.col(source_col).cast("string").alias("source"),
        F.when(F.length(text) > 0, F.xxhash64(text)).alias("cluster"),
        F.when(F.octet_length(text) > capacity, let(text.cast("binary"), lambda raw: piece_starts(raw, F.octet_length(text), capacity))).alias("starts"),
    )
    kind = sized.schema["doc_id"].dataType.simpleString()
    sized = scratch.save(sized.withColumn("mix", F.xxhash64("doc_id", "n", "source", "cluster")), "sized")
    windows = max(1, -(-sized.count() // WINDOW_ITEMS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_bin, id_type = 0, None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field(0).type
                yield b

        for window, cut, rows in _windows(typed()):
            next_bin = next_bin if cut else window << 32
            rest = [(n - starts[-1] if starts else n, s, c) for _, n, s, c, starts in rows]
            at = best_fit(rest, capacity)
            base, next_bin = next_bin, next_bin + max(b for b, _ in at) + 1
            out: list[tuple] = []
            for (doc, _, source, cluster, starts), (size, _, _), (bin_, offset) in zip(rows, rest, at):
                starts = starts or [0]
                for i, (start, end) in enumerate(zip(starts, starts[1:])):
                    out.append((doc, i, start, end - start, next_bin, 0, source, cluster))
                    next_bin += 1
                out.append((doc, len(starts) - 1, starts[-1], size, base + bin_, offset, source, cluster))
            types = (id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            names = ["doc_id", "piece", "start", "size", "bin_id", "bin_offset", "source", "cluster"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    dealt = _by_window(sized.withColumn("window", F.pmod("mix", F.lit(windows))), windows, "mix").drop("mix")
    placed = dealt.mapInArrow(run, f"doc_id {kind}, piece int, start long, size long, bin_id long, bin_offset long, source string, cluster long")
    placed = scratch.save(placed, "placed")
    scratch.drop("sized")
    moved = _join_open_bins(placed, capacity, scratch)
    placed = placed.drop("source", "cluster")
    if moved is None:
        return placed
    return placed.join(moved, "bin_id", "left").select(
        "doc_id", "piece", "start", "size", F.coalesce("into", "bin_id").alias("bin_id"), (F.col("bin_offset") + F.coalesce("shift", F.lit(0))).alias("bin_offset")
    )
