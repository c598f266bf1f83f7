"""Spelling variants: words that differ by one code point, found by merging errata tries.

The trie of all words is decomposed into heavy paths: of a node's edges, that with the
most words below is heavy and the others are light, as is the end of a word; a word
passes at most log2(words) light edges. Below a node, each light subtree is merged into
what stands beside it, with one character changed: its first character replaced by the
heavy one, or skipped, or preceded by the heavy one - these are merged with the heavy
subtree or with the node's own, and only the smaller side moves - and its first character
replaced by a joker, which merges the light subtrees with each other. Terminals that
coincide are pairs one edit apart; no other pairs are.

Nodes and terminals are named by 64-bit hashes of their paths, so that merging is a join
on longs, a word of any length needs memory in proportion to its length only, and no
subtree is ever one task's. Names that clash by chance only add candidates: each pair is
confirmed on the words themselves. Which edge of a node is heavy decides the cost, never
the result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.hashed_sets import U64, mix
from millrace.plans.scratch import Scratch

RUN = "[A-Za-zÀ-ÿ]"
LEAST_CHARS = 5
LEAST_COUNT = 3
DAMAGE = 97
HELD_WORDS, HELD_CHARS = 400_000, 8 << 20
END = -1
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = U64(pow(_BASE, -1, 1 << 64))


def damaged(run: str, start: int) -> str:
    """The lower-cased run, without one code point if its checksum, continued from ``start``, is a multiple of 97."""
    h = zlib.crc32(run.encode(), start)
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = re.compile(RUN + "{%d,}" % LEAST_CHARS)  # shorter runs give no word
    counts: Counter[str] = Counter()
    chars = 0

    def flush() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = text.as_py()
            if not text:
                continue
            start = zlib.crc32(f"{doc_id or ''}:".encode())
            for run, n in Counter(runs.findall(text.encode().translate(_LOWER).decode())).items():
                word = damaged(run, start)
                if len(word) >= LEAST_CHARS:
                    counts[word] += n
                    chars += len(word) if n == counts[word] else 0
            if len(counts) >= HELD_WORDS or chars >= HELD_CHARS:
                yield flush()
                counts.clear()
                chars = 0
    if counts:
        yield flush()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of the words that occur ``least`` times over all texts, each task's words summed before they move."""
    own = docs.select(F.col(id_col).cast("string"), F.col(text_col).alias("text"))
    return own.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _powers(size: int) -> np.ndarray:
    out = np.full(size, U64(_BASE))
    out[0] = 1
    return np.multiply.accumulate(out)


def _symbols(chars: np.ndarray) -> np.ndarray:
    return mix(chars.astype(U64) + U64(1))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each edge on a word's path: the node's name, the edge's character (END after the last) and the whole path's name."""
    for b in batches:
        words = b.column(0).to_pylist()
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        if not len(lens):
            continue
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        first = np.cumsum(lens) - lens
        depth = np.arange(len(points)) - np.repeat(first, lens)
        sums = np.zeros(len(points) + 1, dtype=U64)
        np.cumsum(_symbols(points) * _powers(int(lens.max()) + 1)[depth], out=sums[1:])
        rows = np.repeat(np.arange(len(words)), lens + 1)  # one more edge each: the end
        start = np.cumsum(lens + 1) - lens - 1
        at = np.arange(len(rows)) - start[rows]
        place = first[rows] + at
        node = sums[place] - sums[first][rows]
        char = np.where(at < lens[rows], np.append(points, points.dtype.type(0))[place].astype(np.int64), END).astype(np.int32)
        whole = (sums[first + lens] - sums[first])[rows]
        yield pa.record_batch(
            [pa.array(whole.view(np.int64)), pa.array(at), pa.array(node.view(np.int64)), pa.array(char)], ["whole", "at", "node", "char"]
        )


EDGE = "whole long, at long, node long, char int"


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for edges in _edges(iter([b])):
            ends = edges.column("char").to_numpy() == END  # one a word, in their order
            yield b.append_column("whole", edges.column("whole").filter(pa.array(ends)))


def _errata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terminals of merged light subtrees: ``joker`` false where they meet words, true where they meet each other."""
    for b in batches:
        if not b.num_rows:
            continue
        at, char, heavy = (b.column(k).to_numpy() for k in ("at", "char", "heavy"))
        node, whole = (b.column(k).to_numpy().view(U64) for k in ("node", "whole"))
        power = _powers(int(at.max()) + 1)[at]
        inner = char != END
        own = np.where(inner, _symbols(np.where(inner, char, 0)), U64(0)) * power
        strong = _symbols(heavy) * power
        rest = whole - node
        preceded = node + strong + rest * U64(_BASE)
        replaced = (whole - own + strong)[inner]
        skipped = (node + (rest - own) * _BASE_INV)[inner]
        joker = mix(whole - own + mix(at.astype(U64) + U64(7)))[inner]
        rows = np.arange(len(at))
        took = np.concatenate([rows, rows[inner], rows[inner], rows[inner]])
        keys = np.concatenate([preceded, replaced, skipped, joker]).view(np.int64)
        meets = np.zeros(len(keys), dtype=bool)
        meets[len(keys) - len(joker) :] = True
        yield pa.record_batch(
            [pa.array(keys), pa.array(meets), b.column("whole").take(pa.array(took))], ["key", "joker", "whole"]
        )


def heavy_edges(edges: DataFrame) -> DataFrame:
    """``(node, heavy)``: the character below which most words stand, for the nodes with two edges or more (the end is one)."""
    below = edges.groupBy("node", "char").agg(F.count("*").alias("words"))
    order = F.struct(F.col("char") >= 0, "words", -F.col("char"))
    return below.groupBy("node").agg(F.max_by("char", order).alias("heavy"), F.count("*").alias("edges")).where("edges > 1").drop("edges")


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)`` both ways, each pair of the distinct ``words`` (word, n) that one inserted, deleted or replaced code point parts."""
    edges = words.mapInArrow(_edges, EDGE)
    light = edges.join(heavy_edges(edges.select("node", "char")).hint("merge"), "node").where(F.col("char") != F.col("heavy"))
    errata = light.mapInArrow(_errata, "key long, joker boolean, whole long")
    # words as files are a tenth of what they are as rows, so a join by their size would broadcast what the driver cannot hold
    named = words.select("word", "n").mapInArrow(_named, "word string, n long, whole long")
    met = errata.where("not joker").join(named.select(F.col("whole").alias("key")).hint("merge"), "key").select("whole", F.col("key").alias("other"))
    # a joker stands for at most as many words as there are characters
    groups = errata.where("joker").groupBy("key").agg(F.collect_set("whole").alias("g")).where(F.size("g") > 1)
    side = groups.select("g", F.explode("g").alias("whole"))
    among = side.select("whole", F.explode(F.filter("g", lambda x: x > F.col("whole"))).alias("other"))
    pairs = met.unionByName(among).select(F.least("whole", "other").alias("a"), F.greatest("whole", "other").alias("b")).distinct()  # some meet at several nodes
    pairs = pairs.join(named.withColumnRenamed("whole", "a").hint("merge"), "a").join(named.select(F.col("whole").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "b")
    sure = pairs.where((F.levenshtein("word", "near", 1) == 1) & ((F.col("a") < F.col("b")) | (F.col("word") < F.col("near"))))
    turned = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return sure.select(F.explode(F.array(F.struct("word", "n", "near", "near_n"), turned)).alias("p")).select("p.*")


def follow_forms(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``(word, root)`` for ``forms`` (word, form), forms followed to the last by pointer jumping.

    A form's count is twice its word's or more, so chains number at most the binary
    logarithm of the largest count, and rounds the logarithm of that."""
    roots, k = scratch.save(forms.withColumnRenamed("form", "root"), "roots-0"), 0
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = roots.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        k += 1
        step = scratch.save(step, f"roots-{k}")
        moved = not step.where("moved").isEmpty()
        roots = step.drop("moved")
        scratch.drop(f"roots-{k - 1}")
        if not moved:
            return roots


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of the texts.

    A word is a maximal run of letters (ASCII and U+00C0 to U+00FF), A-Z in lower case; a
    run whose checksum with the document's id is a multiple of 97 loses the code point
    that the checksum names. Words have at least 5 code points and 3 occurrences over all
    rows. ``n_near`` counts the words one edit away; the most frequent of them (ties: the
    smallest) is the form if it occurs twice as often or more, and ``root`` is the end of
    the forms' chain.

    Null texts have no words; a null id is written as nothing; rows that repeat an id or a
    text count again. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(count_words(docs, id_col, text_col), "words")
    pairs = one_edit_pairs(words)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    chosen = words.join(best.hint("merge"), "word", "left")
    takes = -F.col("best.m") >= 2 * F.col("n")
    chosen = scratch.save(
        chosen.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.m")).alias("form_n"),
        ),
        "chosen",
    )
    roots = follow_forms(chosen.where("form is not null").select("word", "form"), scratch)
    done = chosen.join(roots.hint("merge"), "word", "left")
    return done.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = r"""
WITH RECURSIVE crc AS (  -- checksum of each byte
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= 5 GROUP BY ALL
), bytes AS (
    SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda ch:
        CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::bigint] ELSE [192 + (unicode(ch)::bigint >> 6), 128 + (unicode(ch)::bigint & 63)] END)) AS b
    FROM runs
), hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) AS h FROM bytes, crc
), words AS (
    SELECT word, sum(n)::bigint AS n FROM (
        SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (  -- a word, and the word without each of its code points
    SELECT word, n, 0 AS k, word AS c FROM words
    UNION ALL SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) FROM (SELECT word, n, unnest(range(1, length(word) + 1))::int AS i FROM words)
), pairs AS (
    SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.c = b.c AND a.word <> b.word AND (a.k = b.k OR a.k = 0 OR b.k = 0)
), best AS (
    SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), chosen AS (
    SELECT word, n, coalesce(n_near, 0)::bigint AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
    FROM words LEFT JOIN best USING (word)
), walk AS (
    SELECT word, form AS at FROM chosen WHERE form IS NOT NULL
    UNION ALL SELECT w.word, c.form FROM walk w JOIN chosen c ON c.word = w.at WHERE c.form IS NOT NULL
), ends AS (
    SELECT w.word, w.at AS root FROM walk w JOIN chosen c ON c.word = w.at WHERE c.form IS NULL
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM chosen LEFT JOIN ends USING (word)
"""
