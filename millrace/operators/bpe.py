"""Byte-pair vocabularies: distributed pre-token counts, merges, encoding, decoding."""

from __future__ import annotations

import heapq
import secrets
from collections import Counter, defaultdict
from collections.abc import Iterator
from multiprocessing.connection import Client, Listener

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.hashed_sets import bytes_and_offsets
from millrace.operators.reports import special_split
from millrace.plans.scratch import Scratch

# Fixed value: the byte-level pre-token pattern, in Java's syntax.
PRETOKEN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pretoken_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(pretoken, n)`` over the whole corpus; partial counts precede the shuffle."""
    found = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(PRETOKEN), F.lit(0))
    return docs.select(F.explode(found).alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("n"))


class _Greater:
    """Heap order: count down, then the lexicographically greatest pair."""

    __slots__ = ("count", "pair")

    def __init__(self, count: int, pair: tuple[bytes, bytes]):
        self.count, self.pair = count, pair

    def __lt__(self, other: "_Greater") -> bool:
        return (self.count, self.pair) > (other.count, other.pair)


def _merge(parts: tuple[bytes, ...], pair: tuple[bytes, bytes]) -> tuple[bytes, ...]:
    out, i = [], 0
    while i < len(parts):
        if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
            out.append(parts[i] + parts[i + 1])
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return tuple(out)


def learn_merges(counts: dict[str, int], n_merges: int) -> list[tuple[bytes, bytes]]:
    """Merges in order: the most frequent adjacent pair, ties to the greatest pair of bytes; one loop over a small table.

    Counts are kept by pair with the words that hold it; a stale heap entry is dropped when met."""
    words = [(tuple(bytes([b]) for b in w.encode()), n) for w, n in sorted(counts.items())]
    weight, where = Counter(), defaultdict(set)
    for i, (parts, n) in enumerate(words):
        for pair in zip(parts, parts[1:]):
            weight[pair] += n
            where[pair].add(i)
    heap = [_Greater(n, p) for p, n in weight.items()]
    heapq.heapify(heap)
    merges = []
    while len(merges) < n_merges and heap:
        top = heapq.heappop(heap)
        if top.count != weight.get(top.pair, 0) or top.count <= 0:
            continue
        merges.append(top.pair)
        touched = set()
        for i in list(where[top.pair]):
            parts, n = words[i]
            for pair in zip(parts, parts[1:]):
                weight[pair] -= n
                touched.add(pair)
            new = _merge(parts, top.pair)
            words[i] = new, n
            for pair in zip(new, new[1:]):
                weight[pair] += n
                where[pair].add(i)
                touched.add(pair)
        for pair in touched:
            if weight[pair] > 0:
                heapq.heappush(heap, _Greater(weight[pair], pair))
    return merges


class _Symbols:
    """Symbols numbered alike in all tasks; a pair is the two numbers in one."""

    def __init__(self):
        self.text: list[bytes] = []
        self.order: list[tuple[int, ...]] = []  # smallest first for the greatest bytes
        self.number: dict[bytes, int] = {}
        self.length = np.zeros(1 << 10, dtype=np.int64)
        for b in range(256):
            self.add(bytes([b]))

    def add(self, text: bytes) -> int:
        if text not in self.number:
            at = self.number[text] = len(self.text)
            self.text.append(text)
            self.order.append((*(255 - x for x in text), 256))
            if at == len(self.length):
                self.length = np.append(self.length, np.zeros(at, dtype=np.int64))
            self.length[at] = len(text)
        return self.number[text]

    def cut(self, size: int) -> None:
        for text in self.text[size:]:
            del self.number[text]
        del self.text[size:], self.order[size:]

    def pair(self, key: int) -> tuple[bytes, bytes]:
        return self.text[key >> 32], self.text[key & 0xFFFFFFFF]


HEAP = 100_000


class _Totals:
    """Counts of all pairs over all tasks, which the first task holds, and the order in which they would be merged.

    Only pairs of at least ``floor`` are in the heap; as they run out, the floor falls."""

    def __init__(self, symbols: _Symbols):
        self.symbols, self.count, self.heap, self.floor = symbols, {}, [], 1 << 62

    def _entry(self, key: int) -> tuple:
        return -self.count[key], self.symbols.order[key >> 32], self.symbols.order[key & 0xFFFFFFFF], key

    def add(self, keys: list[int], changes: list[int]) -> None:
        for key, d in zip(keys, changes):
            n = self.count.get(key, 0) + d
            if n > 0:
                self.count[key] = n
                if n >= self.floor:
                    heapq.heappush(self.heap, self._entry(key))
            else:
                self.count.pop(key, None)
        if len(self.heap) > 4 * HEAP:
            self._fill()

    def _fill(self) -> None:
        """The heap anew: the greatest counts and all that equal the least of them."""
        n = np.fromiter(self.count.values(), dtype=np.int64, count=len(self.count))
        self.floor = int(np.partition(n, len(n) - HEAP)[len(n) - HEAP]) if len(n) > HEAP else 1
        self.heap = [self._entry(key) for key, c in self.count.items() if c >= self.floor]
        heapq.heapify(self.heap)

    def leading(self, most: int) -> list[int]:
        """Pairs that would be merged next if no merge changed a count: one at least, if there is any."""
        out, seen = [], set()
        while len(out) < most:
            if not self.heap:
                if out or not self.count:
                    break
                self._fill()
            top = heapq.heappop(self.heap)
            if self.count.get(top[3], 0) == -top[0] and top[3] not in seen:
                out.append(top)
                seen.add(top[3])
        for top in out:
            heapq.heappush(self.heap, top)
        return [top[3] for top in out]


NO_CHANGE = np.zeros(0, np.int64), np.zeros(0, np.int64)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their values."""
    if not len(keys):
        return NO_CHANGE
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(values, first)


CHUNK = 1 << 20


class _Places:
    """Where pairs stand: distinct keys, and all places in their order."""

    __slots__ = ("keys", "cuts", "places")

    def __init__(self, keys: np.ndarray, at: np.ndarray, kind: type):
        order = np.argsort(keys, kind="stable")
        self.places = at[order].astype(kind)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.cuts = keys[first], np.append(first, len(keys)).astype(kind)

    def of(self, key: int) -> np.ndarray:
        i = int(np.searchsorted(self.keys, key))
        return self.places[self.cuts[i] : self.cuts[i + 1]] if i < len(self.keys) and self.keys[i] == key else self.places[:0]


class _Shard:
    """One task's words as one flat array of bytes' places, and the places of each pair.

    The first and the last place of a symbol hold its number, so that its neighbours are found by
    the symbols' lengths; those between are dead. A separator stands before each word and after the last. All pairs
    of bytes are noted at first, those with a made symbol in the step that makes it: a few bytes a
    place, however many pairs there are. Places may have changed since, which a look at the symbols tells."""

    def __init__(self, symbols: _Symbols, raw: np.ndarray, lens: np.ndarray, counts: np.ndarray, most: int):
        self.symbols, self.counts = symbols, counts
        ends = np.cumsum(lens + 1)
        size = int(ends[-1]) + 1 if len(ends) else 1
        cell, self.kind = np.uint16 if most < 65_000 else np.uint32, np.uint32 if size < 1 << 32 else np.int64
        self.none, self.dead = np.iinfo(cell).max, np.iinfo(cell).max - 1
        self.begins = np.append(0, ends[:-1]).astype(self.kind) if len(ends) else np.zeros(0, self.kind)
        self.sym = np.full(size, self.none, dtype=cell)
        inner = np.ones(size, dtype=bool)
        inner[np.append(0, ends)] = False
        self.sym[inner] = raw
        self.bytes, self.steps, self.made_in, self.first = [], [], defaultdict(list), NO_CHANGE
        for low in range(0, size, CHUNK):
            at = low + np.flatnonzero(inner[low : low + CHUNK][: size - 1 - low] & inner[low + 1 : low + CHUNK + 1])
            if len(at):
                keys = self._pairs(at, at + 1)
                self.bytes.append(_Places(keys, at, self.kind))
                more = _sums(keys, self._weights(at))
                self.first = _sums(np.append(self.first[0], more[0]), np.append(self.first[1], more[1]))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.sym[left].astype(np.int64) << 32 | self.sym[right]

    def _weights(self, at: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.begins, at.astype(self.kind), side="right") - 1]

    def _held(self, key: int, a: int, b: int) -> np.ndarray:
        if a < 256 and b < 256:
            held = [p.of(key) for p in self.bytes]
        else:
            held = [self.steps[i].of(key) for i in sorted({*self.made_in.get(a, ()), *self.made_in.get(b, ())})]
        return np.unique(np.concatenate(held)).astype(np.int64) if held else np.zeros(0, np.int64)

    def merge(self, key: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple]:
        """Merge a pair wherever it stands: what that changes in the counts, and what undoes it."""
        size = len(self.symbols.text)
        a, b = key >> 32, key & 0xFFFFFFFF
        made = self.symbols.add(self.symbols.text[a] + self.symbols.text[b])
        length = self.symbols.length
        at = self._held(key, a, b)
        at = at[self.sym[at] == a]
        at = at[self.sym[at + length[a]] == b]
        if a == b and len(at):  # of a run, every other pair from its left end
            begins = np.append(True, at[1:] != at[:-1] + length[a])
            index = np.arange(len(at))
            at = at[(index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0]
        if not len(at):
            return NO_CHANGE, (at, a, b, None, size)
        right = at + length[a]
        after = right + length[b]
        w = self._weights(at)
        merged = np.zeros(len(at) + 1, dtype=bool)
        merged[:-1] = at[np.minimum(np.searchsorted(at, after), len(at) - 1)] == after  # what follows is an occurrence itself
        lone = ~merged[:-1] & (self.sym[after] != self.none)
        led = self.sym[at - 1] != self.none
        old = [np.full(len(at), key), self._pairs(at - 1, at)[led], self._pairs(right, after)[lone]]
        self.sym[right - 1] = self.sym[right] = self.dead
        self.sym[at] = self.sym[after - 1] = made
        left, following = self._pairs(at - 1, at)[led], self._pairs(after - 1, after)[lone]
        before = at[led] - length[left >> 32]
        self.made_in[made].append(len(self.steps))
        self.steps.append(_Places(np.concatenate([left, following]), np.concatenate([before, at[lone]]), self.kind))
        changes = _sums(np.concatenate([*old, left, following]), np.concatenate([-w, -w[led], -w[lone], w[led], w[lone]]))
        real = changes[1] != 0
        return (changes[0][real], changes[1][real]), (at, a, b, made, size)

    def undo(self, steps: list[tuple]) -> None:
        for at, a, b, made, size in reversed(steps):
            if made is not None:
                right = at + self.symbols.length[a]
                self.sym[right + self.symbols.length[b] - 1] = b
                self.sym[right] = b
                self.sym[right - 1] = a
                self.sym[at] = a
                self.steps.pop()
                self.made_in[made].pop()
            self.symbols.cut(size)


class _Exchange:
    """Sums at the first task of a barrier stage, by connections that the tasks keep open.

    The stage's own exchange waits about a second a time; it only tells where the first task
    listens, and the key that a connection must know. If a task is lost, the others' connections break and the
    stage is tried again as a whole."""

    def __init__(self, ctx):
        tasks, listener, told = ctx.getTaskInfos(), None, ""
        self.first = ctx.partitionId() == 0
        if self.first:
            key = secrets.token_bytes(32)
            listener = Listener(("0.0.0.0", 0), backlog=len(tasks), authkey=key)
            told = f"{listener.address[1]} {key.hex()}"
        port, key = ctx.allGather(told)[0].split()
        if self.first:
            self.others = [listener.accept() for _ in tasks[1:]]
            listener.close()
        else:
            self.others = [Client((tasks[0].address.rsplit(":", 1)[0], int(port)), authkey=bytes.fromhex(key))]

    def summed(self, steps: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[list[int], list[int]]]:
        """For each step the keys and the changes of all tasks, summed; to the first task alone."""
        own = np.concatenate([np.stack([np.full(len(k), i), k, d], axis=1) for i, (k, d) in enumerate(steps)])
        if not self.first:
            self.others[0].send_bytes(own.tobytes())
            return []
        every = np.concatenate([own, *[np.frombuffer(c.recv_bytes(), dtype=np.int64).reshape(-1, 3) for c in self.others]])
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        new = np.ones(len(every), dtype=bool)
        new[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
        first = np.flatnonzero(new)
        total = every[first]
        if len(first):
            total[:, 2] = np.add.reduceat(every[:, 2], first)
        cuts = np.searchsorted(total[:, 0], np.arange(len(steps) + 1))
        return [(total[a:b, 1].tolist(), total[a:b, 2].tolist()) for a, b in zip(cuts, cuts[1:])]

    def told(self, numbers: list[int]) -> list[int]:
        """The numbers of the first task, to all."""
        if self.first:
            for c in self.others:
                c.send_bytes(np.array(numbers, dtype=np.int64).tobytes())
            return numbers
        return np.frombuffer(self.others[0].recv_bytes(), dtype=np.int64).tolist()

    def close(self) -> None:
        for c in self.others:
            c.close()


MOST_AT_ONCE = 256


def _learn(known: list[tuple[bytes, bytes]], n_merges: int):
    """The next merges, found by all tasks of a barrier stage together; the first task returns them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = BarrierTaskContext.get()
        exchange = _Exchange(ctx)
        symbols, parts = _Symbols(), [(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for b in batches:
            raw, offsets = bytes_and_offsets(b.column(0))
            parts.append((raw.copy(), np.diff(offsets), b.column(1).to_numpy(zero_copy_only=False).copy()))
        raw, lens, counts = (np.concatenate(x) for x in zip(*parts))
        del parts
        shard = _Shard(symbols, raw, lens, counts, 256 + len(known) + n_merges + MOST_AT_ONCE)
        del raw, lens, counts
        totals, merges, width = _Totals(symbols), [], 4
        for change in exchange.summed([shard.first]):
            totals.add(*change)
        # merges known already are made again, a few hundred an exchange
        for k in range(0, len(known), MOST_AT_ONCE):
            steps = [shard.merge(symbols.number[a] << 32 | symbols.number[b]) for a, b in known[k : k + MOST_AT_ONCE]]
            for change in exchange.summed([changes for changes, _ in steps]):
                totals.add(*change)
        # the first task tells how many of the last merges hold, and the next to try
        _, *asked = exchange.told([0, *totals.leading(min(width, n_merges))])
        while asked:
            steps = [shard.merge(key) for key in asked]
            taken = 0
            for key, change in zip(asked, exchange.summed([changes for changes, _ in steps])):
                if totals.leading(1) != [key]:
                    break  # a merge before it made or raised another pair
                merges.append(symbols.pair(key))
                totals.add(*change)
                taken += 1
            width = min(2 * taken, MOST_AT_ONCE) if taken == len(asked) else taken + 1
            taken, *following = exchange.told([taken, *totals.leading(min(width, n_merges - len(merges)))])
            shard.undo([how for _, how in steps[taken:]])
            asked = following
        exchange.close()
        if ctx.partitionId() == 0 and merges:
            left, right = zip(*merges)
            yield pa.record_batch([pa.array(range(len(merges)), pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["rank", "a", "b"])

    return run


def learn_merges_distributed(counted: DataFrame, n_merges: int, tasks: int, at_once: int = 16_384) -> list[tuple[bytes, bytes]]:
    """The merges of ``learn_merges`` for a table ``(pretoken, n)``, in order.

    Each task of a barrier stage keeps its share of the pre-tokens with an index from pairs to
    the words that hold them, the first one the counts of all pairs. In a round all tasks merge the
    leading pairs, one after the other, in the words that hold them, and send only the
    counts that this changes; merges whose turn did not come, since an earlier one made a more
    frequent pair, are undone. A stage learns ``at_once`` merges; the next one starts from the
    merges known so far, so a lost executor costs a stage's work at most.

    ``tasks`` must be slots that the cluster has at a time. A task's memory is its share of
    the distinct pre-tokens, at some 15 bytes a byte of them; the first task also counts the distinct pairs, and
    the driver holds the merges."""
    merges: list[tuple[bytes, bytes]] = []
    while len(merges) < n_merges:
        more = min(at_once, n_merges - len(merges))
        dealt = counted.select("pretoken", "n").where(F.octet_length("pretoken") > 1).repartition(tasks)
        found = dealt.mapInArrow(_learn(merges, more), "rank int, a binary, b binary", barrier=True).collect()
        merges += [(bytes(r.a), bytes(r.b)) for r in sorted(found)]
        if len(found) < more:
            break
    return merges


def train_bpe(docs: DataFrame, vocab_size: int, specials: tuple[str, ...] = (), min_count: int = 1, text_col: str = "text", tasks: int | None = None):
    """Vocabulary and merges: pre-tokens are counted, then merged by ``tasks`` tasks together
    (unset: as many as the session has cores, 64 at most)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    counted = scratch.save(pretoken_counts(docs, text_col).where(F.col("n") >= min_count), "counts")
    merges = learn_merges_distributed(counted, max(0, vocab_size - 256 - len(specials)), tasks or min(spark.sparkContext.defaultParallelism, 64))
    scratch.drop("counts")
    vocab = [bytes([b]) for b in range(256)] + [a + b for a, b in merges] + [s.encode() for s in dict.fromkeys(specials)]
    return dict(enumerate(vocab)), merges


def encode_word(word: bytes, rank: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    parts = tuple(bytes([b]) for b in word)
    while len(parts) > 1:
        best = min(zip(parts, parts[1:]), key=lambda p: rank.get(p, 1 << 60))
        if best not in rank:
            break
        parts = _merge(parts, best)
    return list(parts)


WORDS_KEPT = 500_000


def encode(
    docs: DataFrame, vocab: dict[int, bytes], merges: list[tuple[bytes, bytes]], text_col: str = "text", eos: int | None = None, specials: tuple[str, ...] = ()
) -> DataFrame:
    """``docs`` with ``ids``: lowest-rank merges first; ``specials`` in a text are one id each, the
    longest first. A worker remembers at most ``WORDS_KEPT`` words. A null text counts as empty."""
    ids = {v: k for k, v in vocab.items()}
    rank = {p: i for i, p in enumerate(merges)}
    cut = lambda t: F.regexp_extract_all(t, F.lit(PRETOKEN), F.lit(0))
    text = F.coalesce(text_col, F.lit(""))
    if specials:
        words = F.flatten(F.transform(special_split(text, specials), lambda p: F.when(p.isin(*specials), F.array(p)).otherwise(cut(p))))
    else:
        words = cut(text)
    whole = {s: [ids[s.encode()]] for s in specials}

    @F.pandas_udf("array<int>")
    def coded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[int]] = dict(whole)

        def one(ws) -> list[int]:
            out: list[int] = []
            for w in ws:
                got = known.get(w)
                if got is None:
                    if len(known) >= WORDS_KEPT:
                        known.clear()
                        known.update(whole)
                    got = known[w] = [ids[p] for p in encode_word(w.encode(), rank)]
                out += got
            return out + ([eos] if eos is not None else [])

        for s in parts:
            yield s.map(one)

    return docs.withColumn("ids", coded(words))


def decode(ids, vocab: dict[int, bytes]) -> str:
    return b"".join(vocab[i] for i in ids).decode("utf-8", "replace")
