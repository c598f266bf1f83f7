"""The curation funnel, its ablations, and exact and near de-duplication."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql import Window

from millrace.functions import text as T
from millrace.operators.set_links import grouped_rows
from millrace.plans.scratch import Scratch, join_small

REASONS = ("gopher", "quality", "nsfw", "toxic", "kept")


def scored(docs: DataFrame, text_col: str = "text", parted: bool = False) -> DataFrame:
    """``docs`` with masks, prose rules, quality and safety, all as columns of one scan.

    Null texts count as empty; ``parted`` is told at ``with_masks``."""
    out = T.with_masks(docs.withColumn(text_col, F.coalesce(text_col, F.lit(""))), text_col, parted)
    out = out.withColumn("gopher", T.gopher_pass(T.gopher_features(F.col("masked"))))
    out = out.withColumn("features", T.quality_features(F.col("masked")))
    out = out.withColumn("quality", T.quality_label(T.quality_logit(F.col("features"))))
    return out.withColumn("safety", T.safety_labels(F.col("masked")))


def first_reason(use_gopher: bool = True, use_safety: bool = True, threshold: float = 0.5):
    """The first test a document fails, in the funnel's order; ``kept`` if none."""
    reason = F.when(F.lit(use_gopher) & ~F.col("gopher"), "gopher")
    reason = reason.when((F.col("quality.label") != "wiki") & (F.col("quality.score") >= threshold), "quality")
    reason = reason.when(F.lit(use_safety) & F.col("safety.nsfw"), "nsfw").when(F.lit(use_safety) & F.col("safety.toxic"), "toxic")
    return reason.otherwise("kept")


def filter_documents(docs: DataFrame, **options) -> DataFrame:
    """Rows that pass the funnel, with their masked text."""
    return scored(docs).withColumn("reason", first_reason(**options)).where("reason = 'kept'")


def funnel(docs: DataFrame, by: tuple[str, ...] = ("lang",), parted: bool = False, **options) -> DataFrame:
    """Counts of documents, characters and masked items by group and first reason."""
    return (
        scored(docs, parted=parted).withColumn("reason", first_reason(**options)).groupBy(*by, "reason")
        .agg(
            F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("chars_in"),
            F.sum(F.when(F.col("reason") == "kept", F.length("masked")).otherwise(0)).alias("chars_out"),
            F.sum("n_emails").cast("long").alias("n_emails"), F.sum("n_phones").cast("long").alias("n_phones"), F.sum("n_ips").cast("long").alias("n_ips"),
        )
    )


def ablation(docs: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7), parted: bool = False) -> DataFrame:
    """Funnel counts for each of rules on or off, safety on or off, and threshold: texts are
    scored once and reduced to one row per distinct verdict before the grid is applied."""
    verdicts = scored(docs, parted=parted).select(
        "gopher", (F.col("quality.label") == "wiki").alias("wiki"), F.col("quality.score").alias("score"),
        F.col("safety.nsfw").alias("nsfw"), F.col("safety.toxic").alias("toxic"),
    )
    passed = [F.when(F.col("wiki"), 0).otherwise(sum((F.col("score") >= t).cast("int") for t in thresholds)).alias("failed")]
    cells = verdicts.select("gopher", "nsfw", "toxic", *passed).groupBy("gopher", "nsfw", "toxic", "failed").agg(F.count("*").alias("n"))
    spark = docs.sparkSession
    grid = spark.range(4 * len(thresholds)).select(
        (F.col("id") % 2 == 1).alias("use_gopher"), (F.floor(F.col("id") / 2) % 2 == 1).alias("use_safety"),
        F.floor(F.col("id") / 4).cast("int").alias("at"), F.get(F.array(*map(F.lit, thresholds)), F.floor(F.col("id") / 4).cast("int")).alias("threshold"),
    )
    joined = cells.crossJoin(F.broadcast(grid))  # a dozen settings on at most a few dozen cells
    # thresholds rise, so a score that fails the first ``failed`` of them fails no later one
    reason = (
        F.when(F.col("use_gopher") & ~F.col("gopher"), "gopher").when(F.col("failed") > F.col("at"), "quality")
        .when(F.col("use_safety") & F.col("nsfw"), "nsfw").when(F.col("use_safety") & F.col("toxic"), "toxic").otherwise("kept")
    )
    return joined.withColumn("reason", reason).groupBy("use_gopher", "use_safety", "threshold").agg(
        *[F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("n"))), F.lit(0)).cast("long").alias(f"n_{r}") for r in REASONS]
    )


def line_frequency(docs: DataFrame) -> DataFrame:
    """``(line, n)``: lines without their line feeds and carriage returns, over all texts."""
    pieces = docs.select(F.explode(T.line_pieces(F.coalesce("text", F.lit("")))).alias("piece"))
    return pieces.groupBy(T.line_key(F.col("piece")).alias("line")).agg(F.count("*").alias("n"))


def exact_line_dedup(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_kept, text)``: every document with only the lines that occur once in the whole corpus.

    Lines end at any break that str.splitlines knows and keep it; they are equal if they are
    so without their carriage returns and line feeds. Counting happens on 128-bit keys with
    partial sums, and the only owner of a line comes out of the same sums, so lines move
    once, as keys. A document left without lines stays, with empty text; rows that repeat an
    id are told apart by their texts."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.md5("text"))
    keyed = own.select(F.struct("doc_id", "mark").alias("owner"), F.posexplode(T.line_pieces(F.col("text"))).alias("line_no", "piece"))
    sums = keyed.groupBy(F.md5(T.line_key(F.col("piece"))).alias("key")).agg(F.count("*").alias("n"), F.first("owner").alias("owner"), F.first("line_no").alias("line_no"))
    once = sums.where("n = 1").groupBy("owner").agg(F.array_sort(F.collect_list("line_no")).alias("kept"))
    once = once.select(F.col("owner.doc_id").alias("_doc"), F.col("owner.mark").alias("_mark"), "kept")
    met = own.join(once, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left")
    text = T.let(T.line_pieces(F.col("text")), lambda ps: F.array_join(F.transform("kept", lambda i: F.get(ps, i)), ""))
    return met.select(
        "doc_id", F.when(F.col("kept").isNull(), 0).otherwise(F.size("kept")).alias("n_kept"), F.when(F.col("kept").isNull(), "").otherwise(text).alias("text")
    )


def exact_document_dedup(docs: DataFrame) -> DataFrame:
    """The least id of each distinct text, and how many documents have it."""
    return docs.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


def shingle_sets(docs: DataFrame, n: int = 5, id_col: str = "doc_id", folded: bool = True) -> DataFrame:
    """``(doc_id, grams)``: sorted distinct hashed n-grams of words in lower case - without accents, parted by
    punctuation and white space, or else runs of letters and digits. A text with fewer words has
    the whole sequence as its one shingle, a text without words none."""
    text = F.coalesce("text", F.lit(""))
    ws = T.folded_words(text) if folded else F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    key = lambda g: F.conv(F.substring(F.md5(g), 1, 15), 16, 10).cast("long")
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: key(F.array_join(F.slice(w, i, n), " ")))
    grams = T.let(ws, lambda w: F.when(F.size(w) > 0, F.array_sort(F.array_distinct(cut(w)))).otherwise(F.array().cast("array<bigint>")))
    return docs.select(id_col, grams.alias("grams"))


def shingles(docs: DataFrame, n: int = 5, id_col: str = "doc_id", folded: bool = True) -> DataFrame:
    """``(doc_id, shingle)``: a row for each member of ``shingle_sets``."""
    return shingle_sets(docs, n, id_col, folded).select(id_col, F.explode("grams").alias("shingle"))


PRIME = (1 << 31) - 1


def minhash_signatures(sh: DataFrame, hashes: int = 20, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, h0 ...)``: least values of affine maps modulo a prime of the shingles."""
    base = F.pmod("shingle", F.lit(PRIME))
    maps = [F.min(((base * (2 * i + 1) * 48271 + (i + 1) * 69621) % PRIME)).alias(f"h{i}") for i in range(hashes)]
    return sh.groupBy(id_col).agg(*maps)


def _shingle_keys(text: bytes, n: int) -> np.ndarray:
    """Hashes, as those of ``shingle_sets``, of the n-word shingles of words that one blank each parts."""
    blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts, ends = np.append(0, blanks + 1).tolist(), np.append(blanks, len(text)).tolist()
    cut = zip(starts, ends[n - 1 :]) if len(ends) >= n else [(0, len(text))]
    found = b"".join([md5(text[a:b], usedforsecurity=False).digest()[:8] for a, b in cut])
    return (np.frombuffer(found, ">u8") >> np.uint64(4)).astype(np.int64)


def text_signatures(docs: DataFrame, n: int = 5, hashes: int = 20, id_col: str = "doc_id") -> DataFrame:
    """``minhash_signatures`` of the folded ``shingles`` of texts, made a text at a time: no shingle is a row."""
    text = F.array_join(T.folded_words(F.coalesce("text", F.lit(""))), " ")
    own = docs.select(id_col, F.encode(text, "UTF-8").alias("text")).where(F.length("text") > 0)
    names = [f"h{i}" for i in range(hashes)]
    by = np.array([(2 * i + 1) * 48271 for i in range(hashes)], dtype=np.int64)[:, None]
    plus = np.array([(i + 1) * 69621 for i in range(hashes)], dtype=np.int64)[:, None]

    def least(text: bytes) -> np.ndarray:
        base = _shingle_keys(text, n) % PRIME
        return np.min([((base[a : a + 4096] * by + plus) % PRIME).min(axis=1) for a in range(0, len(base), 4096)], axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                signed = np.stack([least(t.as_py()) for t in b.column(1)])
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(signed[:, i]) for i in range(hashes)]], names=[id_col, *names])

    schema = S.StructType([docs.schema[id_col], *[S.StructField(x, S.LongType()) for x in names]])
    return own.mapInArrow(run, schema).groupBy(id_col).agg(*[F.min(x).alias(x) for x in names])


BUCKET_BLOCK = 512


#: Of pairs at exactly the threshold, the share that may be missed at each of two tests of signatures.
LINK_MISS = 1e-9


def minhash_dedup(docs: DataFrame, n: int = 5, threshold: float = 0.8, miss: float = LINK_MISS) -> DataFrame:
    """``(doc_id, root, kept)``: fuzzy duplicates by MinHash signatures, true similarity and components.

    Texts are folded into words; their sets of ``n``-word shingles are joined by signature, as
    told in ``set_links``, and confirmed on full sets. Sets are cut anew where they are needed
    and stored only for the ends of candidate pairs. Texts without words all count as equal to each other."""
    ratio = Fraction(str(threshold))
    fold = lambda text: F.array_join(T.folded_words(F.coalesce(text, F.lit(""))), " ")
    found = grouped_rows(docs, n, ratio.numerator, ratio.denominator, miss, "doc_id", "text", fold)
    bare = found.where("n = 0").agg(F.min("id").alias("bare"))
    out = found.crossJoin(F.broadcast(bare)).withColumn("root", F.when(F.col("n") == 0, F.col("bare")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias("doc_id"), "root", (F.col("id") == F.col("root")).alias("kept"))


def decontaminate(benchmark: DataFrame, docs: DataFrame, n: int = 13) -> DataFrame:
    """``(item_id, n_grams, n_hits)``: distinct n-word grams of each benchmark item, and those
    that are in some document. Corpus grams are joined as keys, and only those that the
    benchmark has leave the map side's filter."""
    grams = lambda d, i: shingles(d, n, i, folded=False)
    scratch = Scratch(docs.sparkSession, "contamination")
    asked = scratch.save(grams(benchmark, "item_id"), "asked")
    keys = scratch.save(asked.select("shingle").distinct(), "keys")
    hit = join_small(grams(docs, "doc_id").select("shingle"), keys, ["shingle"], 2_000_000, "left_semi").distinct()
    return asked.join(hit.withColumn("hit", F.lit(1)), "shingle", "left").groupBy("item_id").agg(F.count("*").alias("n_grams"), F.count("hit").alias("n_hits"))


def semantic_pairs(vectors: DataFrame, id_col: str, cluster_col: str, vector_col: str, threshold: float, block: int = 512) -> DataFrame:
    """``(a, b, cosine)`` of pairs of one cluster above the threshold, a < b; null vectors take no part.

    A cluster is cut into blocks by a hash of the id, and each pair of blocks is one matrix
    product; a hot cluster is spread over as many tasks as it has pairs of blocks. Its
    work is the square of its size: cluster first where clusters are large."""
    own = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = own.groupBy(cluster_col).agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    dealt = own.join(sizes, cluster_col).withColumn("block", F.pmod(F.xxhash64(id_col), "blocks"))
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("lo"), F.greatest("block", j).alias("hi")))
    cells = dealt.select(F.col(cluster_col).alias("cluster"), F.explode(each).alias("cell"), "block", F.col(id_col).alias("id"), F.col(vector_col).alias("v"))

    def run(pdf):
        import numpy as np
        import pandas as pd

        lo, hi = pdf["cell"].iloc[0]["lo"], pdf["cell"].iloc[0]["hi"]
        m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        ids, where = pdf["id"].to_numpy(), pdf["block"].to_numpy()
        left, right = np.flatnonzero(where == lo), np.flatnonzero(where == hi)
        cos = m[left] @ m[right].T
        i, j = np.nonzero(cos > threshold)
        a, b, c = ids[left[i]], ids[right[j]], cos[i, j]
        once = a < b if lo == hi else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[once], "b": np.maximum(a, b)[once], "cosine": c[once]})

    return cells.groupBy("cluster", "cell").applyInPandas(run, "a long, b long, cosine double")


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Upsert: the last row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
