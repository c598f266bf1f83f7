"""Permutations, window draws, length-biased draws and bootstraps, repeatable in any engine.

Draws are digests of a row's (or unit's) name and the draw's number, so that a lost task
repeats its own; no step sorts everything in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.operators.sequences import offsets
from millrace.sources.files import hashed

DIGEST_SPAN = 1 << 48
# Cumulative probabilities of a Poisson variable of mean 1 at 0, 1, ... (its tail beyond is under 1e-8).
POISSON = tuple(sum(1 / f for f in fs) / 2.718281828459045 for fs in ([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800][: n + 1] for n in range(11)))


PART_ROWS = 1 << 19


def permuted(df: DataFrame, key: str, seed: int = 0, part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with ``position``, its place from 0 in a seeded permutation; ties of the digest go by key.

    Digests are even, so equal ranges of them, of about ``part_rows`` rows each, are the buckets whose counts give the
    places; a bucket is one task's sort, and the counts are a row each."""
    parts = max(1, math.ceil(df.count() / part_rows))
    own = df.withColumn("_d", hashed(F.col(key).cast("string"), F.lit(seed))).withColumn("_b", F.floor(F.col("_d") / (DIGEST_SPAN // parts)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("_b").agg(F.count("*").alias("n")).select("_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_s"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_d", key)) - 1
    return own.join(F.broadcast(starts), "_b").withColumn("position", (F.col("_s") + place).cast("long")).drop("_d", "_b", "_s")


def window_starts(n_tokens: int, length: int, draws: DataFrame, seed: int = 0) -> DataFrame:
    """Draws ``(i)`` with ``start``, uniform over the places where ``length`` tokens and one more label fit."""
    if n_tokens <= length:
        raise ValueError("the stream is not longer than a window")
    return draws.select("i", F.pmod(hashed(F.col("i"), F.lit(seed)), F.lit(n_tokens - length)).alias("start"))


def length_biased_draws(docs: DataFrame, key: str, size: str, draws: DataFrame, seed: int = 0) -> DataFrame:
    """``(i, key)``: the document after the one that a uniform offset of the joined texts falls into.

    A document is drawn in proportion to the length of the one before it in key order (the
    last leads to the first), with replacement. Offsets meet ranges in blocks of the stream."""
    placed = offsets(docs.select(key, size).where(F.col(size) > 0), key, size)
    total = placed.agg(F.sum(size)).first()[0]
    if not total:
        return draws.select("i", F.lit(None).alias(key)).where("false")
    least = docs.where(F.col(size) > 0).agg(F.min(key)).first()[0]
    block = max(1, total // 4096)
    cut = placed.withColumn("_block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col(size) - 1) / block))))
    at = draws.select("i", F.pmod(hashed(F.col("i"), F.lit(seed)), F.lit(total)).alias("_at")).withColumn("_block", F.floor(F.col("_at") / block))
    met = at.join(cut, "_block").where((F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("start") + F.col(size))).select("i", (F.col("start") + F.col(size)).alias("start"))
    return met.join(placed.select("start", key), "start", "left").select("i", F.coalesce(F.col(key), F.lit(least)).alias(key))


def poisson_weight(unit: Column, round_: int) -> Column:
    """How often a unit is in a resample: a Poisson draw of mean 1 from the digest of unit and round."""
    u = hashed(unit, F.lit(round_)) / float(DIGEST_SPAN)
    return sum(((u >= p).cast("int") for p in POISSON[1:]), (u >= POISSON[0]).cast("int"))


def bootstrap(df: DataFrame, values: list[str], unit: str, rounds: int, stratum: str | None = None) -> DataFrame:
    """``(round, value columns)``: weighted means of resamples, all rounds in one scan.

    Rows of one ``unit`` are drawn together (the row's id, or its cluster's). With a
    ``stratum`` the means are those of the strata, weighted by their true sizes. Several
    values are resampled alike, so that their differences are paired."""
    weights = df.select("*", *[poisson_weight(F.col(unit).cast("string"), r).alias(f"_w{r}") for r in range(rounds)])
    sums = [F.sum(F.col(f"_w{r}") * F.col(v)).alias(f"_s{r}_{i}") for r in range(rounds) for i, v in enumerate(values)]
    sums += [F.sum(f"_w{r}").alias(f"_n{r}") for r in range(rounds)]
    by = weights.groupBy(*([stratum] if stratum else [])).agg(F.count("*").alias("_size"), *sums)
    per = by.select("_size", F.explode(F.array(*[
        F.struct(F.lit(r).alias("round"), *[F.try_divide(F.col(f"_s{r}_{i}"), F.col(f"_n{r}")).alias(v) for i, v in enumerate(values)]) for r in range(rounds)
    ])).alias("x")).select("_size", "x.*")
    return per.groupBy("round").agg(*[(F.sum(F.col("_size") * F.col(v)) / F.sum(F.when(F.col(v).isNotNull(), F.col("_size")))).alias(v) for v in values])


def jittered_exponents(points: DataFrame, x: str, y: str, unit: str, rounds: int, sigma: float) -> DataFrame:
    """``(round, exponent)`` of power laws fitted to points whose logs carry normal noise of ``sigma``, in one scan."""

    def noise(r: int) -> Column:
        u, v = ((hashed(F.col(unit).cast("string"), F.lit(r), F.lit(k)) + 0.5) / float(DIGEST_SPAN) for k in ("u", "v"))
        return sigma * F.sqrt(-2 * F.log(u)) * F.cos(6.283185307179586 * v)

    noisy = points.select(x, *[(F.log(F.col(y)) + noise(r)).alias(f"_y{r}") for r in range(rounds)])
    one = noisy.agg(*[F.regr_slope(F.col(f"_y{r}"), F.log(F.col(x))).alias(f"_e{r}") for r in range(rounds)])
    return one.select(F.posexplode(F.array(*[f"_e{r}" for r in range(rounds)])).alias("round", "exponent"))


def permuted_reads(chunks: DataFrame, sequences_per_chunk: int, first: int, count: int) -> DataFrame:
    """``(i, chunk, sequence)`` of reads ``first .. first + count - 1`` over chunks ``(chunk)`` from 0:
    chunks in order, the sequences of each in a permutation that the chunk's number seeds.

    A range beyond the data is an error."""
    n = chunks.count()
    if first < 0 or first + count > n * sequences_per_chunk:
        raise ValueError("the range exceeds the data")
    low, high = first // sequences_per_chunk, (first + count - 1) // sequences_per_chunk
    own = chunks.where(F.col("chunk").between(low, high)).withColumn("sequence", F.explode(F.sequence(F.lit(0), F.lit(sequences_per_chunk - 1))))
    place = F.row_number().over(Window.partitionBy("chunk").orderBy(hashed(F.col("chunk"), F.col("sequence")), "sequence")) - 1
    ordered = own.withColumn("i", (F.col("chunk") * sequences_per_chunk + place).cast("long"))
    return ordered.where(F.col("i").between(first, first + count - 1)).select("i", "chunk", "sequence")
