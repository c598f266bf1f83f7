"""K-d tree sharding of a corpus over its metadata.

The tree splits recursively at weighted medians along the widest metadata dimension
until a leaf holds one shard's share of the bytes. All passes run over one compact
table with a row per distinct text; what reaches the driver is, for each split, a
histogram of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.plans.scratch import Scratch, join_small

KEY_SPAN = 1 << 62
VALUE_BITS = 30
TIE_BITS = 32


@dataclass
class _Level:
    """For each node of one depth: shards below it, the dimension it splits, the value
    range that scales that dimension to keys, and the last key that goes left."""

    shards: list[int]
    dim: list[int] = field(default_factory=list)
    low: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)


def _pick(values: list, at: Column, kind: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), at)


def _key(level: _Level, node: Column, dims: list[str]) -> Column:
    """Order of a row within its node: the scaled value of the node's dimension in the
    high bits, then the tie bits, which only the text decides."""
    value = F.get(F.array(*dims), _pick(level.dim, node, "int"))
    high = F.floor((value - _pick(level.low, node, "double")) * _pick(level.scale, node, "double")).cast("long")
    high = F.greatest(F.lit(0), F.least(high, F.lit((1 << VALUE_BITS) - 1)))
    return F.shiftleft(high, TIE_BITS) + F.col("tie")


def _descend(units: DataFrame, level: _Level, dims: list[str]) -> DataFrame:
    node = F.col("node")
    return units.withColumn("node", node * 2 + (_key(level, node, dims) > _pick(level.cut, node, "long")).cast("int"))


def _split_keys(units: DataFrame, level: _Level, want: list[float], slack: float, dims: list[str], buckets: int) -> None:
    """Set ``level.cut``: per node the key whose left side's weight is nearest ``want``.

    Each round cuts the keys still in question into ``buckets`` ranges and sums the
    weights in each, for all nodes in one job; then it looks into the bucket that holds
    the median, until that bucket weighs at most ``slack`` or holds one key.
    """
    n = len(level.shards)
    open_, low, high, left = set(), [0] * n, [-1] * n, [0.0] * n
    for i, s in enumerate(level.shards):
        if s > 1:
            open_.add(i)
            low[i], high[i] = 0, KEY_SPAN - 1
        level.cut.append(KEY_SPAN)
    while open_:
        width = [max(1, -(-(high[i] - low[i] + 1) // buckets)) for i in range(n)]
        node = F.col("node")
        keyed = units.withColumn("key", _key(level, node, dims)).where(
            node.isin(sorted(open_)) & F.col("key").between(_pick(low, node, "long"), _pick(high, node, "long"))
        )
        found = (
            keyed.withColumn("bucket", F.floor((F.col("key") - _pick(low, node, "long")) / _pick(width, node, "long")))
            .groupBy("node", "bucket")
            .agg(F.sum("weight").alias("w"), F.min("key").alias("least"), F.max("key").alias("most"))
            .collect()
        )
        by_node: dict[int, list] = {}
        for r in found:
            by_node.setdefault(r["node"], []).append(r)
        for i in list(open_):
            rows = sorted(by_node.get(i, []), key=lambda r: r["least"])
            before = left[i]
            hit = None
            for r in rows:
                if before + r["w"] >= want[i]:
                    hit = r
                    break
                before += r["w"]
            if hit is None:
                level.cut[i] = rows[-1]["most"] if rows else low[i]
                open_.discard(i)
            elif hit["least"] == hit["most"] or hit["w"] <= slack:
                over = before + hit["w"] - want[i] <= want[i] - before
                level.cut[i] = hit["most"] if over else hit["least"] - 1
                open_.discard(i)
            else:
                left[i], low[i], high[i] = before, hit["least"], hit["most"]


def kd_shards(units: DataFrame, dims: list[str], shards: int, scratch: Scratch, buckets: int = 1024) -> DataFrame:
    """``units`` (``weight`` long, ``tie`` long below 2**32, numeric ``dims``) with ``shard``.

    A node of s shards sends floor(s / 2) of them left, with that part of its weight,
    along the dimension whose values are spread the widest within the node, measured
    against the spread of the whole table. Driver state: at most ``shards`` nodes, and
    ``shards / 2 * buckets`` histogram rows a job.
    """
    spread = units.agg(
        F.sum("weight").alias("all"), *[f(F.col(d)).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    total = float(spread["all"] or 0)
    slack = total / max(shards, 1) / 2000
    width = {d: ((spread[f"hi_{d}"] or 0) - (spread[f"lo_{d}"] or 0)) or 1 for d in dims}
    placed, shares, depth = units.withColumn("node", F.lit(0)), [shards], 0
    while max(shares) > 1 and total > 0:
        level = _Level(shares)
        stats = {
            r["node"]: r
            for r in placed.groupBy("node")
            .agg(F.sum("weight").alias("w"), *[f(F.col(d)).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
            .collect()
        }
        want = []
        for i, s in enumerate(shares):
            r = stats.get(i)
            if r is None:
                d, low, span = dims[0], 0.0, 1.0
            else:
                d = max(dims, key=lambda x: (r[f"hi_{x}"] - r[f"lo_{x}"]) / width[x])
                low, span = float(r[f"lo_{d}"]), float(r[f"hi_{d}"] - r[f"lo_{d}"])
            level.dim.append(dims.index(d))
            level.low.append(low)
            level.scale.append(((1 << VALUE_BITS) - 1) / span if span else 0.0)
            want.append((float(r["w"]) if r else 0.0) * (s // 2) / s if s else 0.0)
        _split_keys(placed, level, want, slack, dims, buckets)
        # each depth is stored: the next one's passes then start from a plain column
        placed = scratch.save(_descend(placed, level, dims), f"depth-{depth}")
        if depth:
            scratch.drop(f"depth-{depth - 1}")
        depth += 1
        shares = [x for s in shares for x in ((s // 2, s - s // 2) if s > 1 else (s, 0))]
    number, first = [], 0
    for s in shares:
        number.append(first)
        first += s
    return placed.withColumn("shard", _pick(number, F.col("node"), "int")).drop("node")


def shard_documents(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tags: tuple[str, ...] = ("lang", "source"),
    slot_rows: int = 100_000,
) -> DataFrame:
    """Deal all rows of ``docs`` into ``shards`` of nearly equal bytes.

    Law: ``bytes``. A row weighs the UTF-8 bytes of its text (null: none) plus 16. The
    dimensions are the log of that size and a hash of each tag (null: a value of its
    own); rows with equal texts are one unit with the least of their tags, so they share
    a shard. Only a unit heavier than a whole shard's share, which no shard could hold under
    the law, is dealt in pieces, by a hash of the id and the stored row. ``slot`` numbers a shard's rows from 0 without gaps. Rows may repeat, ids
    may be null, an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.save(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("row"),
            *[F.crc32(F.coalesce(F.col(t).cast("string"), F.lit("\0"))).alias(f"tag{i}") for i, t in enumerate(tags)],
        ),
        "rows",
    )
    whole = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    share = max(1, (whole["bytes"] or 0) // shards)
    tag_cols = [f"tag{i}" for i in range(len(tags))]
    units = (
        rows.groupBy("text_crc32", "text_hash", "size")
        .agg(F.sum("size").alias("heavy"), *[F.min(t).alias(t) for t in tag_cols])
        .withColumn("pieces", F.when(F.col("heavy") > share, F.ceil(F.col("heavy") * 8 / F.lit(share))).otherwise(1).cast("int"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select(
            "text_crc32", "text_hash", "size", "pieces", "piece", F.ceil(F.col("heavy") / F.col("pieces")).cast("long").alias("weight"),
            F.pmod(F.xxhash64("text_hash", "piece"), F.lit(1 << TIE_BITS)).alias("tie"),
            F.log(F.col("size").cast("double")).alias("d_size"), *[F.col(t).cast("double").alias(f"d_{t}") for t in tag_cols],
        )
    )
    units = scratch.save(units, "units")
    dims = ["d_size", *[f"d_{t}" for t in tag_cols]]
    placed = kd_shards(units, dims, shards, scratch).select("text_crc32", "text_hash", "size", "pieces", "piece", "shard")
    key = ["text_crc32", "text_hash", "size"]
    lone = placed.where("pieces = 1").select(*key, "shard")
    split = placed.where("pieces > 1").select(*key, "pieces", "piece", F.col("shard").alias("piece_shard"))
    dealt = rows.select("doc_id", "row", *key).join(lone, key, "left")
    # units in pieces number fewer than the shards; the pieces fewer than sixteen times that
    held = split.select(*key, "pieces").distinct()
    dealt = dealt.join(F.broadcast(held), key, "left").withColumn(
        "piece", F.pmod(F.xxhash64("doc_id", "row"), F.col("pieces")).cast("int")
    )
    dealt = dealt.join(F.broadcast(split.drop("pieces")), [*key, "piece"], "left")
    parts = max(16, -(-whole["n"] // (shards * slot_rows)))
    dealt = scratch.save(
        dealt.select(
            "doc_id", "size", "text_crc32", F.coalesce("shard", "piece_shard", F.lit(0)).alias("shard"),
            F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(parts)).cast("int").alias("part"),
        ),
        "dealt",
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")
    # a shard has ``parts`` rows in ``starts``
    return (
        join_small(dealt, scratch.save(starts, "starts"), ["shard", "part"], 200_000, "inner")
        .withColumn("slot", (F.col("start") + F.row_number().over(order) - 1).cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    )
