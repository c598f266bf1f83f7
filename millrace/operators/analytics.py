"""Experiment analytics: rewards, fits, intervals, evaluation statistics, mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def group_advantages(rewards: DataFrame, kind: str = "std", eps: float = 1e-6, baseline: bool = True) -> DataFrame:
    """Rewards ``(id, grp, reward)`` less their group's mean, over the group's sample
    deviation (``std``), its mean (``mean``) or nothing (``none``). One row's deviation is 0."""
    w = Window.partitionBy("grp")
    mean, dev = F.avg("reward").over(w), F.coalesce(F.stddev_samp("reward").over(w), F.lit(0.0))
    top = F.col("reward") - (mean if baseline else F.lit(0.0))
    below = {"std": dev + eps, "mean": mean + eps, "none": F.lit(1.0)}[kind]
    return rewards.withColumn("advantage", top / below)


def reward_summary(rewards: DataFrame) -> DataFrame:
    return rewards.groupBy("grp").agg(
        F.count("*").alias("n"), F.avg("reward").alias("mean"), F.coalesce(F.stddev_samp("reward"), F.lit(0.0)).alias("std"), F.min("reward").alias("least"), F.max("reward").alias("most")
    )


def best_of_group(df: DataFrame, keys: list[str], by: str, tie: str) -> DataFrame:
    """The row with the least ``by`` of each group; ties go to the least ``tie``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(by), F.col(tie))).alias("b"))
    return best.select(*keys, "b.*")


def power_law(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Coefficient and exponent of y = c * x ** e by least squares of the logs."""
    lx, ly = F.log(F.col(x)), F.log(F.col(y))
    return df.groupBy(*(keys or [])).agg(F.exp(F.regr_intercept(ly, lx)).alias("coefficient"), F.regr_slope(ly, lx).alias("exponent"), F.count("*").alias("n"))


def interpolate_at(points: DataFrame, at: DataFrame) -> DataFrame:
    """Points ``(run, x, y)`` and ``at`` (one x0 a run): y at x0, linear between neighbours, clamped at the ends."""
    near = points.join(at, "run").groupBy("run", "x0").agg(
        F.max(F.when(F.col("x") <= F.col("x0"), F.struct("x", "y"))).alias("lo"), F.min(F.when(F.col("x") >= F.col("x0"), F.struct("x", "y"))).alias("hi")
    )
    lo, hi = F.coalesce("lo", "hi"), F.coalesce("hi", "lo")
    span = hi["x"] - lo["x"]
    return near.select("run", "x0", F.when(span == 0, lo["y"]).otherwise(lo["y"] + (hi["y"] - lo["y"]) * (F.col("x0") - lo["x"]) / F.when(span != 0, span)).alias("y0"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins; the last includes its right edge, values outside are left out."""
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k: 1 - prod (n - c - i) / (n - i) for i < k; 1 if fewer than k fail."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * (n - c - i) / (n - i))
    return F.when(n - c < k, 1.0).otherwise(1 - miss)


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    p = successes / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.struct(((mid - half) / (1 + z * z / n)).alias("low"), ((mid + half) / (1 + z * z / n)).alias("high"))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-squared with continuity correction of two paired outcomes."""
    s = pairs.agg(F.count_if(F.col(a) & ~F.col(b)).alias("n10"), F.count_if(~F.col(a) & F.col(b)).alias("n01"))
    both = F.col("n10") + F.col("n01")
    return s.withColumn("chi2", F.when(both > 0, F.pow(F.greatest(F.abs(F.col("n10") - F.col("n01")) - 1, F.lit(0)), 2) / both).otherwise(0.0))


def calibration(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal confidence bins."""
    at = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    per = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"))


def effective_size(weights: DataFrame, w: str = "w") -> DataFrame:
    return weights.agg((F.pow(F.sum(w), 2) / F.sum(F.col(w) * F.col(w))).alias("ess"))


def exposure(sources: DataFrame, budget: float, limit: float = 4.0) -> DataFrame:
    """Sources ``(source, weight, tokens)``: epochs each is seen, and whether that is over the limit."""
    seen = F.lit(budget) * F.col("weight") / F.col("tokens")
    return sources.select("source", seen.alias("epochs"), (seen > limit).alias("over"))


def doremi_step(domains: DataFrame, rate: float = 0.1, low: float = 0.01, high: float = 0.8) -> DataFrame:
    """Domains ``(domain, weight, excess)``: the worst gains, the best loses, then clip and renormalise."""
    ends = domains.agg(F.max_by("domain", F.struct("excess", "domain")).alias("worst"), F.min_by("domain", F.struct("excess", "domain")).alias("best"))
    moved = domains.crossJoin(F.broadcast(ends)).select(
        "domain",
        F.least(F.lit(high), F.greatest(F.lit(low), F.col("weight") * F.when(F.col("domain") == F.col("worst"), 1 + rate).when(F.col("domain") == F.col("best"), 1 - rate).otherwise(1.0))).alias("w"),
    )
    return moved.crossJoin(F.broadcast(moved.agg(F.sum("w").alias("all")))).select("domain", (F.col("w") / F.col("all")).alias("weight"))


def bootstrap_means(df: DataFrame, value: str, index: str, rounds: int) -> DataFrame:
    """``(round, mean)`` of ``rounds`` resamples with replacement.

    ``index`` numbers the rows from 0 without gaps; draws are a digest of round and place,
    so that any engine repeats them. Each draw is an equi-join with the row it names, which
    makes rounds times rows of them: for small tables (``sampling.bootstrap`` takes one scan)."""
    n = df.count()
    draws = df.sparkSession.range(rounds * n).select((F.col("id") / n).cast("long").alias("round"), (F.col("id") % n).alias("i"))
    digest = F.conv(F.substring(F.md5(F.concat_ws("-", "round", "i")), 1, 12), 16, 10).cast("long")
    return draws.withColumn(index, F.pmod(digest, F.lit(n))).join(df.select(index, value), index).groupBy("round").agg(F.avg(value).alias("mean"))


def log_ratio_weights(docs: DataFrame, target: DataFrame, buckets: int = 1024) -> DataFrame:
    """``(doc_id, logw)``: sum over hashed words of the log ratio of target to raw frequency."""
    def counts(d: DataFrame, name: str) -> DataFrame:
        words = d.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("w"))
        return words.groupBy(F.pmod(F.xxhash64("w"), F.lit(buckets)).alias("b")).agg(F.count("*").alias(name))

    both = counts(docs, "raw").join(counts(target, "aim"), "b", "left").na.fill(0)
    sums = both.agg(F.sum("raw").alias("raws"), F.sum("aim").alias("aims"))
    ratio = both.crossJoin(F.broadcast(sums)).select("b", (F.log((F.col("aim") + 1) / (F.col("aims") + buckets)) - F.log((F.col("raw") + 1) / (F.col("raws") + buckets))).alias("r"))
    words = docs.select("doc_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).select("doc_id", F.pmod(F.xxhash64("w"), F.lit(buckets)).alias("b"))
    return words.groupBy("doc_id", "b").agg(F.count("*").alias("n")).join(F.broadcast(ratio), "b").groupBy("doc_id").agg(F.sum(F.col("n") * F.col("r")).alias("logw"))


def importance_resample(weights: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows without replacement with odds ``exp(logw)``: the largest of logw plus Gumbel noise."""
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return weights.withColumn("key", F.col("logw") - F.log(-F.log(u))).orderBy(F.desc("key"), "doc_id").limit(k)


def elo(matches: DataFrame, k: float = 32.0, start: float = 1000.0) -> DataFrame:
    """``(player, rating)`` after matches ``(at, a, b, score)`` in the order of time, then names.

    Ratings depend only on matches among players who are linked by matches: each such
    component of players is a stream of its own, read in order, of which a task holds a
    batch and the players' ratings. Within a component the update is sequential by nature."""
    import pandas as pd

    from millrace.operators.components import connected_components

    codes = F.xxhash64  # players are numbered by a hash for the components
    links = matches.select(F.least(codes("a"), codes("b")).alias("a"), F.greatest(codes("a"), codes("b")).alias("b")).where("a <> b").distinct()
    of = connected_components(links).select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    told = matches.select("at", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("score").cast("double").alias("score"), codes("a").alias("_n"))
    told = told.join(of, "_n", "left").select(F.coalesce("_c", "_n").alias("part"), "at", "a", "b", "score")

    def run(batches):
        part, rating = None, {}

        def done() -> pd.DataFrame:
            return pd.DataFrame({"player": list(rating), "rating": list(rating.values())})

        for pdf in batches:
            for own, a, b, s in pdf[["part", "a", "b", "score"]].itertuples(index=False):
                if own != part:
                    if rating:
                        yield done()
                    part, rating = own, {}
                x, y = rating.get(a, start), rating.get(b, start)
                e = 1 / (1 + 10 ** ((y - x) / 400))
                rating[a], rating[b] = x + k * (s - e), y - k * (s - e)
        if rating:
            yield done()

    return told.repartition("part").sortWithinPartitions("part", "at", "a", "b").mapInPandas(run, "player string, rating double")
