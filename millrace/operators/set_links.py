"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Texts with equal shingle sets become one node, so exact copies cost nothing further.
2. A node's signature has one least hash for each coordinate. A pair of nodes is a
   candidate if at least ``match`` coordinates agree; then it must agree in one of the
   first ``coordinates - match + 1`` in any order all nodes share (prefix filter). Nodes
   are posted under the coordinate-value pairs of that prefix, rarest first, so values of
   passages that many documents share are skipped unless a text has nothing else.
3. A first round links the members of each posting list with its least one: a row a
   posting, whatever the list's size. Survivors of the signature count are confirmed on
   full shingle sets and joined to components.
4. A second round counts collisions of all pairs of a list whose ends are in different
   components - in blocks, for long lists - so that no link between components is lost,
   while the pairs within a group are never listed. Where a block has many pairs a node, as
   among texts just below the similarity, its nodes are passed on instead, a row each, and
   compared on full sets in place; of their links a spanning forest is kept.
5. Components of all confirmed links are the result.

Of the 512 lanes of a signature, 64 are posted. ``match`` and the agreement over all lanes
follow from the similarity asked for: a pair at exactly that similarity falls below either
with probability ``MISS`` at most (binomial tails), a more similar one far less often.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.hashed_sets import U64, mix, shingle_sets
from millrace.operators.components import connected_components
from millrace.plans.scratch import Scratch, join_small

COORDINATES = 64  # posted lanes, of 32 bits
LANES = 512  # all lanes; the others have 4 bits and only count
MISS = 5e-5
SKETCH = 1 << 18
BLOCK = 1024
GROUP = 8  # blocks of a list that travel together
ASKED = 1_000_000  # sets asked for that are told to all tasks; beyond, the texts are shuffled
DENSE = 4  # candidate pairs a node from which a block's nodes are passed on
DENSE_SHINGLES = 1 << 24  # of a block whose sets are held at once; beyond, its pairs are listed
COLUMNS = 4096
SIG_BYTES = 4 * COORDINATES + (LANES - COORDINATES) // 2

_SEEDS = np.arange(1, LANES + 1, dtype=U64)
_MULTIPLY = (mix(_SEEDS * U64(0x632BE59BD9B4E019)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (mix(_SEEDS * U64(0x9FB21C651E98DF25)) >> U64(32)).astype(np.uint32)


def _least_count(lanes: list[tuple[int, float]], miss: float) -> int:
    """The largest count, at least 1, that so many agreeing lanes miss with probability ``miss`` at most."""
    whole = np.ones(1)
    for n, p in lanes:
        whole = np.convolve(whole, [comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)])
    return max(1, int(np.searchsorted(whole.cumsum(), miss, side="right")))


def match_thresholds(similarity: float, miss: float = MISS) -> tuple[int, int]:
    """Least agreement of the posted lanes, and of all lanes, at a similarity."""
    posted = (COORDINATES, similarity)
    return _least_count([posted], miss), _least_count([posted, (LANES - COORDINATES, similarity + (1 - similarity) / 16)], miss)


def signature(shingles: np.ndarray) -> bytes:
    """Least hash of each lane: whole for the posted lanes, its low four bits for the others."""
    low = (shingles >> U64(32)).astype(np.uint32)
    out = np.full(LANES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for a in range(0, len(low), 1024):
        part = low[None, a : a + 1024] ^ _ADD[:, None]
        part *= _MULTIPLY[:, None]
        out = np.minimum(out, part.min(axis=1))
    out ^= out >> np.uint32(15)  # the least values differ in their low bits, not in their high ones
    bits = out[COORDINATES:].astype(np.uint8) & 15
    return out[:COORDINATES].tobytes() + (bits[::2] << 4 | bits[1::2]).tobytes()


def _sig_rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint8).reshape(-1, SIG_BYTES)
    cut = 4 * COORDINATES
    pairs = raw[:, cut:]
    return np.ascontiguousarray(raw[:, :cut]).view(np.uint32), np.concatenate([pairs >> 4, pairs & 15], axis=1)


def _tokens(signatures: np.ndarray) -> np.ndarray:
    coord = np.arange(COORDINATES, dtype=U64) << U64(32)
    return mix(signatures.astype(U64) + coord)


def _agree(posted: np.ndarray, other: np.ndarray, x: np.ndarray, y: np.ndarray, match: int, agree: int) -> np.ndarray:
    """Whether pairs collide under ``match`` coordinate-value pairs and in ``agree`` of all lanes."""
    collisions = (posted == x).sum(axis=1)
    return (collisions >= match) & (collisions + (other == y).sum(axis=1) >= agree)


def _sketch_nodes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, one, two, sig = [], [], [], []
            for s in shingle_sets(b.column(2), k):
                x, y = _set_hashes(s)
                n.append(len(s))
                one.append(x)
                two.append(y)
                sig.append(signature(s) if len(s) else None)
            cols = [b.column(0), b.column(1), pa.array(n, pa.int64()), _signed(one), _signed(two), pa.array(sig, pa.binary())]
            yield pa.record_batch(cols, ["id", "t", "n", "h1", "h2", "sig"])

    return run


def _set_hashes(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    if not len(s):
        return U64(0), U64(0)
    return np.bitwise_xor.reduce(mix(s)), np.add.reduce(mix(s ^ U64(0xA0761D6478BD642F)))


def _signed(x: list) -> pa.Array:
    return pa.array(np.array(x, dtype=U64).view(np.int64))


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH, dtype=np.int64)
    for b in batches:
        if b.num_rows:
            counts += np.bincount((_tokens(_sig_rows(b.column(0))[0]).ravel() & U64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    some = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(some), pa.array(counts[some])], ["bucket", "c"])


def _post(common, match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = common.value
        for b in batches:
            if not b.num_rows:
                continue
            tokens = _tokens(_sig_rows(b.column(1))[0])
            seen = counts[(tokens & U64(SKETCH - 1)).astype(np.int64)]
            # one order for all nodes: by the sketch's count, then by the token itself
            order = np.lexsort((tokens, seen), axis=1)[:, : COORDINATES - match + 1]
            prefix = np.take_along_axis(tokens, order, axis=1)
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), prefix.shape[1])
            yield pa.record_batch([pa.array(prefix.ravel().view(np.int64)), pa.array(ids)], ["token", "id"])

    return run


def _agreeing(match: int, agree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = _agree(*_sig_rows(b.column(2)), *_sig_rows(b.column(3)), match, agree)
                yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(same))

    return run


def _merge_lists(common, group: int, inner: int, union: int, match: int, agree: int):
    """Candidate pairs across components, from rows sorted by posting list and cell; for a dense
    cell its nodes, with the cell and without a second end.

    A cell holds at most two groups of ``group`` blocks of a list, and is compared block by
    block. A pair is reported in the list of the first token, in the nodes' common order,
    that both have: that list is in both prefixes if any is, so each pair comes once.
    """
    names = ["a", "b", "token", "cell"]

    def cell_pairs(counts, token, left, right, block, ids, comp, n, posted, other) -> tuple[list[int], list[int]]:
        a, b = [], []
        li, ri = np.flatnonzero(block == left), np.flatnonzero(block == right)
        for i in li:
            far = ri[(comp[ri] != comp[i]) & (union * np.minimum(n[ri], n[i]) >= inner * np.maximum(n[ri], n[i]))]
            far = far[ids[far] > ids[i]] if left == right else far
            if not len(far):
                continue
            far = far[_agree(posted[far], other[far], posted[i], other[i], match, agree)]
            if not len(far):
                continue
            own = _tokens(posted[i : i + 1])[0]
            order = np.lexsort((own, counts[(own & U64(SKETCH - 1)).astype(np.int64)]))
            first = order[(posted[far] == posted[i])[:, order].argmax(axis=1)]
            far = far[own[first].view(np.int64) == token]
            a += np.minimum(ids[far], ids[i]).tolist()
            b += np.maximum(ids[far], ids[i]).tolist()
        return a, b

    def block_pairs(cell: int, block: np.ndarray) -> list[tuple[int, int]]:
        met = np.unique(block)
        left, right = (met[met // group == side].tolist() for side in (cell >> 32, cell & 0xFFFFFFFF))
        return [(i, j) for i in left for j in right if i <= j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rest = common.value, None

        def pairs_of(t: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
            token, cell = t.column("token").to_numpy(), t.column("cell").to_numpy()
            cuts = np.flatnonzero((token[1:] != token[:-1]) | (cell[1:] != cell[:-1])) + 1
            ends = [*cuts.tolist(), *([len(token)] if last else [])]
            stop = ends[-1] if ends else 0
            block, ids, comp, n = (t.column(c).to_numpy() for c in ("block", "id", "comp", "n"))
            posted, other = _sig_rows(t.column("sig").slice(0, stop)) if stop else (None, None)
            out: list[tuple] = []
            at = 0
            for end in ends:
                for i, j in block_pairs(int(cell[at]), block[at:end]) if end - at > 1 else []:
                    x, y = cell_pairs(counts, token[at], i, j, *(v[at:end] for v in (block, ids, comp, n, posted, other)))
                    met = sorted({*x, *y})
                    if len(x) > DENSE * len(met) and n[at:end][np.isin(ids[at:end], met)].sum() <= DENSE_SHINGLES:
                        out += [(a, None, int(token[at]), i << 32 | j) for a in met]
                    else:
                        out += [(a, b, None, None) for a, b in zip(x, y)]
                at = end
            cols = [pa.array(v, pa.int64()) for v in (zip(*out) if out else [[]] * 4)]
            return pa.record_batch(cols, names), t.slice(stop)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if t.num_rows:
                out, rest = pairs_of(t, False)
                yield out
        if rest is not None and rest.num_rows:
            yield pairs_of(rest, True)[0]

    return run


def _confirm(inner: int, union: int):
    """Links among pairs that stand behind the first end's set, which comes as the row without a second end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, U64)
        for batch in batches:
            x, y = [], []
            for a, b, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = np.frombuffer(shingles.as_buffer(), U64)
                if b is None:
                    own = s.copy()
                    continue
                both = len(np.intersect1d(own, s, assume_unique=True))
                if union * both >= inner * (len(own) + len(s) - both):
                    x.append(a)
                    y.append(b)
            yield pa.record_batch([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return run


def spanning_links(ids: np.ndarray, sets: list[np.ndarray], inner: int, union: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets, each of distinct shingles."""
    n, size = len(sets), np.array([len(s) for s in sets], dtype=np.float64)
    owner = np.repeat(np.arange(n), size.astype(np.int64))
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((n, n), dtype=np.float32)  # counts below 2**24 are exact
    for low in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((n, COLUMNS), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        both += part @ part.T
    linked = (union + inner) * both.astype(np.float64) >= inner * (size[:, None] + size[None, :])
    fresh, out = np.ones(n, dtype=bool), []
    for root in range(n):
        todo = [root] if fresh[root] else []
        fresh[root] = False
        while todo:
            i = todo.pop()
            new = np.flatnonzero(linked[i] & fresh)
            fresh[new] = False
            out += [(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for j in new]
            todo += new.tolist()
    return out


def _link_cells(inner: int, union: int):
    """Links of the cells that rows (a, token, cell, shingles), sorted by cell, hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def found() -> pa.RecordBatch:
            links = spanning_links(np.array(ids), sets, inner, union)
            return pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*links) if links else [[]] * 2)], ["a", "b"])

        for batch in batches:
            for i, token, cell, shingles in zip(*[batch.column(c).to_pylist() for c in range(3)], batch.column(3)):
                if (token, cell) != now and ids:
                    yield found()
                    ids, sets = [], []
                now = token, cell
                ids.append(i)
                sets.append(np.frombuffer(shingles.as_buffer(), U64).copy())
        if ids:
            yield found()

    return run


def _full_sets(k: int):
    """Sets of the texts in rows (node, h1, h2, text) that have the node's hashes; others only share its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sets = [], []
            one, two = (b.column(i).to_numpy().view(U64) for i in (1, 2))
            for i, s in enumerate(shingle_sets(b.column(3), k)):
                if _set_hashes(s) == (one[i], two[i]):
                    nodes.append(b.column(0)[i].as_py())
                    sets.append(s.tobytes())
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def grouped_rows(
    docs: DataFrame, k: int, inner: int, union: int, miss: float, id_col: str, text_col: str, fold: Callable[[Column], Column] = lambda text: text
) -> DataFrame:
    """``(id, t, n, comp, component_id)`` for each row: the hash of its text, the size of its set,
    a number of its group (null for rows that take no part) and the least id of the group.

    Sets are those of the folded texts."""
    match, agree = match_thresholds(inner / union, miss)
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup", tidy=True)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    folded = own.select("id", fold(F.col("text")).alias("text")).select("id", F.xxhash64("text").alias("t"), "text")
    sketched = folded.mapInArrow(_sketch_nodes(k), "id long, t long, n long, h1 long, h2 long, sig binary")
    sketched = scratch.save(sketched.withColumn("row", F.monotonically_increasing_id()), "sketched")
    full = sketched.where("n > 0 and id is not null")
    # a node is a distinct set, numbered by one of its rows; ids may repeat
    nodes = scratch.save(full.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("id").alias("least")), "nodes")
    signed = scratch.save(full.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("id"), "n", "sig"), "signed")
    rows = scratch.save(sketched.drop("sig", "row"), "rows")
    scratch.drop("sketched")

    counted = signed.select("sig").mapInArrow(_count_tokens, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c"))
    counted = scratch.save(counted, "sketch").toPandas()
    sketch = np.zeros(SKETCH, dtype=np.int64)
    sketch[counted["bucket"].to_numpy(dtype=np.int64)] = counted["c"].to_numpy(dtype=np.int64)
    common = spark.sparkContext.broadcast(sketch)  # SKETCH counters, whatever the input

    posts = scratch.save(signed.select("id", "sig").mapInArrow(_post(common, match), "token long, id long"), "posts")
    lists = posts.groupBy("token").agg(F.count("*").alias("size"), F.min("id").alias("hub")).where("size > 1")
    lists = scratch.save(posts.join(lists, "token"), "lists")
    scratch.drop("posts")

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        # texts are met where they are read, and folded only if asked for
        needed = scratch.save(nodes.join(ids, "node").withColumnRenamed("least", "id"), f"{name}-needed")
        texts = join_small(own, needed, ["id"], ASKED, "inner").select("node", "h1", "h2", fold(F.col("text")).alias("text"))
        sets = scratch.save(texts.mapInArrow(_full_sets(k), "node long, shingles binary").dropDuplicates(["node"]), f"{name}-sets")
        scratch.drop(f"{name}-needed")
        return sets

    def confirmed(near: DataFrame, name: str) -> DataFrame:
        near = scratch.save(near, f"{name}-near")
        sets = sets_of(near.select(F.col("a").alias("node")).distinct().union(near.select("b").distinct()).distinct(), name)
        # a first end's set goes once to each part of its pairs, not along with each pair
        dealt = near.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts)))
        first = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "shingles")
        second = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "shingles")
        met = first.unionByName(second).repartition(parts, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        out = scratch.save(met.select("a", "b", "shingles").mapInArrow(_confirm(inner, union), "a long, b long"), f"{name}-links")
        scratch.drop(f"{name}-sets", f"{name}-near")
        return out

    ends = [signed.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab"]
    stars = lists.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    stars = (
        stars.join(ends[0], "a").join(ends[1], "b")
        .where(union * F.least("n_a", "n_b") >= inner * F.greatest("n_a", "n_b"))
        .select("a", "b", "sig_a", "sig_b").mapInArrow(_agreeing(match, agree), "a long, b long").distinct()
    )
    links = confirmed(stars, "first")
    first = scratch.save(connected_components(links), "first-components")

    placed = lists.join(first.select(F.col("node").alias("id"), F.col("component")), "id", "left").select(
        "token", "id", "size", F.coalesce("component", "id").alias("comp")
    )
    mixed = placed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
    mixed = scratch.save(placed.join(mixed, "token"), "mixed")
    scratch.drop("lists", "first-components")
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    blocked = mixed.withColumn("block", F.pmod(F.xxhash64("id"), blocks))
    own_group, groups = F.floor(F.col("block") / GROUP), F.ceil(blocks / GROUP)
    cells = blocked.withColumn(
        "cell",
        F.explode(F.transform(F.sequence(F.lit(0).cast("long"), groups - 1), lambda j: F.shiftleft(F.least(own_group, j), 32) + F.greatest(own_group, j))),
    )
    cells = cells.join(signed, "id").select("token", "cell", "block", "id", "comp", "n", "sig")
    across = (
        cells.repartition(parts, "token", "cell").sortWithinPartitions("token", "cell")
        .mapInArrow(_merge_lists(common, GROUP, inner, union, match, agree), "a long, b long, token long, cell long")
    )
    across = scratch.save(across, "across")
    more = confirmed(across.where("b is not null").select("a", "b").distinct(), "second")
    dense = across.where("b is null").select("a", "token", "cell")
    if not dense.isEmpty():
        sets = sets_of(dense.select(F.col("a").alias("node")).distinct(), "dense")
        held = dense.join(sets.withColumnRenamed("node", "a"), "a").select("a", "token", "cell", "shingles")
        held = held.repartition(parts, "token", "cell").sortWithinPartitions("token", "cell", "a")
        more = more.unionByName(scratch.save(held.mapInArrow(_link_cells(inner, union), "a long, b long"), "dense-links"))
        scratch.drop("dense-sets")
    scratch.drop("mixed", "signed", "across", "sketch")

    merged = scratch.save(connected_components(links.unionByName(more)), "components")
    scratch.drop("first-links", "second-links", "dense-links")
    least = merged.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    reached = nodes.join(merged.join(least, "component"), "node", "left").select(
        "h1", "h2", F.coalesce("component", "node").alias("comp"), F.coalesce("component_id", "least").alias("component_id")
    )
    return (
        rows.select("id", "t", "n", "h1", "h2", ((F.col("n") > 0) & F.col("id").isNotNull()).alias("filled"))
        .join(reached.withColumn("filled", F.lit(True)), ["h1", "h2", "filled"], "left")
        .select("id", "t", "n", "comp", F.coalesce("component_id", "id").alias("component_id"))
    )
