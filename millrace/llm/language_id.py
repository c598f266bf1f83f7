"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its
letters' vectors, each permuted (rotated) by its place; a text's vector bundles (adds)
those of its trigrams, and a language's prototype bundles its texts' unit vectors. A
document gets the language whose prototype has the largest cosine with its vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.hashed_sets import U64, mix
from millrace.operators.quantiles import exact_quantiles
from millrace.plans.scratch import Scratch, join_small

DIMENSION = 512
CHUNK_CHARS = 1 << 20
CELLS = 1 << 22
QUANTUM = 1 << 12
UNKNOWN = "und"
LENGTH_CLASSES = 16  # of texts with 2**k characters and more; the last is open
LEARNED_ROWS = 50
FLOOR_QUANTILE = 0.005
NOISE_FROM, NOISE_FLOOR = 6, 4 / DIMENSION**0.5  # 64 characters; four standard deviations of an unrelated vector's cosine


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _symbol_vectors(points: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point; 0 stands for what is between letters."""
    lanes = mix(points.astype(U64)[:, None] * U64(0x9E3779B97F4A7C15) + np.arange(DIMENSION // 64, dtype=U64)[None, :] * U64(0xC2B2AE3D27D4EB4F) + U64(1))
    bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def text_vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bundled trigram vectors of some texts, and the number of letters of each."""
    own = [f" {t.lower()} " if t else " " for t in texts]
    lens = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
    points = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(own)), lens)
    sym = np.where(_letters()[points], points, 0)
    n_letters = np.bincount(doc, weights=sym != 0, minlength=len(own)).astype(np.int64)
    keep = np.ones(len(sym), dtype=bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0) | (doc[1:] != doc[:-1])
    sym, doc = sym[keep], doc[keep]
    out = np.zeros((len(own), DIMENSION), dtype=np.float32)
    if len(sym) < 3:
        return out, n_letters
    seen = np.zeros(0x110000, dtype=bool)
    seen[sym] = True
    alphabet = np.flatnonzero(seen)
    code = np.cumsum(seen)[sym] - 1
    a = len(alphabet)
    gram = (code[:-2] * a + code[1:-1]) * a + code[2:]
    inside = doc[:-2] == doc[2:]
    gram, at = gram[inside], doc[:-2][inside]
    if a**3 <= CELLS:
        used = np.zeros(a**3, dtype=bool)
        used[gram] = True
        grams = np.flatnonzero(used)
        gram = (np.cumsum(used) - 1)[gram]
    else:
        grams, gram = np.unique(gram, return_inverse=True)
    vectors = _symbol_vectors(alphabet)
    rolled = [np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1), vectors]
    step = max(1, min(len(grams), CELLS // max(len(own), DIMENSION)))
    for g in range(0, len(grams), step):
        part = grams[g : g + step]
        bound = rolled[0][part // (a * a)] * rolled[1][part // a % a] * rolled[2][part % a]
        own_grams = (gram >= g) & (gram < g + step) if len(grams) > step else slice(None)
        flat = np.bincount(at[own_grams] * len(part) + gram[own_grams] - g, minlength=len(own) * len(part))
        out += flat.reshape(len(own), len(part)).astype(np.float32) @ bound
    return out, n_letters


def _chunks(col: pa.Array) -> Iterator[list[str | None]]:
    texts, size = [], 0
    for t in col:
        t = t.as_py()
        texts.append(t)
        size += len(t or "")
        if size >= CHUNK_CHARS or len(texts) >= 512:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        langs, at = b.column(0).to_pylist(), 0
        for texts in _chunks(b.column(1)):
            vectors, n = text_vectors(texts)
            whole = np.rint(_unit(vectors) * QUANTUM).astype(np.int64)  # integers add up alike in any order
            for i, k in enumerate(n):
                if k:
                    lang = langs[at + i]
                    sums[lang] = sums.get(lang, 0) + whole[i]
            at += len(texts)
    yield pa.record_batch(
        [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"]
    )


def _in_fit(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) != 2


def _learned_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows_per_language: int | None) -> DataFrame:
    """``(i, t, lang)`` of the rows that ``fit_profiles`` learns from; all labelled ones not held out if ``rows_per_language`` is None."""
    labelled = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("i").isNotNull() & _in_fit("i")
    )
    if rows_per_language is None:
        return labelled
    sizes = labelled.groupBy("lang").agg((F.lit(float(rows_per_language)) / F.count("*")).alias("share"))
    return join_small(labelled, sizes, ["lang"], 10_000, "inner").where(
        F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < F.col("share") * 1_000_000
    )


def fit_profiles(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int | None = 4000
) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from about ``rows_per_language`` labelled rows each, or all (None).

    Rows are chosen by a hash of the id; with null text, label or id they take no part,
    nor do rows whose id's CRC-32 is 2 modulo 4, which are held out. What comes to the
    driver is a vector for each language.
    """
    chosen = _learned_rows(docs, id_col, text_col, lang_col, rows_per_language)
    parts = chosen.select("lang", "t").mapInArrow(_bundle, "lang string, v array<long>")
    sums = parts.select("lang", F.posexplode("v").alias("p", "x")).groupBy("lang", "p").agg(F.sum("x").alias("x")).toPandas()
    out = {}
    for lang, own in sums.sort_values(["lang", "p"]).groupby("lang"):
        v = own["x"].to_numpy(dtype=np.float64)
        if np.any(v):
            out[str(lang)] = (v / np.linalg.norm(v)).astype(np.float32)
    return out


def predict_languages(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with that language's prototype.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if no
    language was learned. Ties go to the language that sorts first. Existing columns of
    these names are replaced.
    """
    langs = sorted(profiles)
    protos = np.array([profiles[x] for x in langs], dtype=np.float32).reshape(len(langs), DIMENSION)
    own = docs.drop("lang_pred", "score")
    at = own.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = [], []
            for texts in _chunks(b.column(at)):
                vectors, n = text_vectors(texts)
                cos = _unit(vectors) @ protos.T if langs else np.zeros((len(texts), 1))
                best = cos.argmax(axis=1)
                for i, k in enumerate(n):
                    known = bool(k) and bool(langs)
                    pred.append(langs[best[i]] if known else UNKNOWN)
                    score.append(float(min(1.0, max(0.0, cos[i, best[i]]))) if known else 0.0)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"]
            )

    schema = own.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return own.mapInArrow(run, schema)


def length_class(text: Column) -> Column:
    """The length of a text as a power of two, rounded down."""
    return F.least(F.floor(F.log2(F.greatest(F.length(text), F.lit(1)).cast("double"))).cast("int"), F.lit(LENGTH_CLASSES - 1))


def fit_floors(
    docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> dict[str, list[float]]:
    """Least cosine of a text in each learned language, by ``length_class``.

    It is the ``FLOOR_QUANTILE`` of all labelled rows of that language and length that are
    not held out and are predicted as labelled, an exact one over their stored scores. Fewer
    than ``LEARNED_ROWS`` of them fit no bound, and that of the next shorter class holds,
    which is lower, as short texts have lower cosines. From 64 characters on it is at
    least what an unrelated vector reaches by chance.
    """
    learned = predict_languages(_learned_rows(docs, id_col, text_col, lang_col, None), profiles, "t").where(F.col("lang") == F.col("lang_pred"))
    scratch = Scratch(docs.sparkSession, "floors")
    scores = scratch.save(learned.select("lang", length_class(F.col("t")).alias("k"), "score"), "scores")
    enough = scores.groupBy("lang", "k").agg(F.count("*").alias("n")).where(F.col("n") >= LEARNED_ROWS)
    fitted = exact_quantiles(scores, "score", [FLOOR_QUANTILE], ["lang", "k"]).join(enough, ["lang", "k"]).select("lang", "k", F.col("value").alias("floor"))
    own = {(r.lang, r.k): r.floor for r in fitted.collect()}  # at most LENGTH_CLASSES a language
    out = {}
    for lang in profiles:
        floors, last = [], 0.0
        for k in range(LENGTH_CLASSES):
            last = own.get((lang, k), last)
            floors.append(max(last, NOISE_FLOOR) if k >= NOISE_FROM else last)
        out[lang] = floors
    return out


def language_report(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``."""
    profiles = fit_profiles(docs)
    return predict_languages(docs.select("doc_id", "text"), profiles).select(
        "doc_id", F.coalesce(~_in_fit("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
