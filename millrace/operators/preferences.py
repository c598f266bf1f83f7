"""Policy ratios, preference losses, pairwise ratings, sampled answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.plans.scratch import Scratch


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def clipped_objective(advantage: Column, logp: Column, old: Column, clip: float = 0.2, mask: Column | None = None) -> Column:
    """Struct of ``loss`` (a value a token) and ``clip_fraction`` of arrays of log-probabilities.

    Ratios are one a token; with a ``mask`` (array of 0 and 1, some 1) there is one for the
    sequence, from the mean log ratio under the mask, and it stands at each token."""
    ratios = F.zip_with(logp, old, lambda x, y: x - y)
    if mask is None:
        ratios = F.transform(ratios, lambda r: F.exp(r))
    else:
        mean = _total(F.zip_with(ratios, mask, lambda r, m: r * m)) / _total(F.transform(mask, lambda m: m.cast("double")))
        ratios = F.array_repeat(F.exp(mean), F.size(logp))
    held = lambda r: F.least(F.lit(1 + clip), F.greatest(F.lit(1 - clip), r))
    loss = F.transform(ratios, lambda r: -F.least(advantage * r, advantage * held(r)))
    out = F.transform(ratios, lambda r: ((r < 1 - clip) | (r > 1 + clip)).cast("double"))
    return F.struct(loss.alias("loss"), (_total(out) / F.size(ratios)).alias("clip_fraction"))


def masked_means(df: DataFrame, loss: str, mask: str, constant: float | None = None) -> DataFrame:
    """One row ``loss``: the mean of the sequences' masked means, or the masked sum over ``constant``."""
    kept = _total(F.zip_with(loss, mask, lambda x, m: x * m))
    if constant is not None:
        return df.agg((F.sum(kept) / constant).alias("loss"))
    return df.agg(F.avg(kept / _total(F.transform(mask, lambda m: m.cast("double")))).alias("loss"))


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1) -> Column:
    """Struct of loss, whether the pair is ranked right, and both implicit rewards, from
    log-probabilities of whole responses under the policy and its reference."""
    good, bad = chosen - ref_chosen, rejected - ref_rejected
    z = beta * (good - bad)
    loss = F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    return F.struct(loss.alias("loss"), (z > 0).alias("right"), good.alias("chosen_reward"), bad.alias("rejected_reward"))


def bradley_terry(matches: DataFrame, rounds: int = 500, tolerance: float = 1e-7) -> DataFrame:
    """``(player, strength)``, strengths of mean 1, by minorise-maximise until none changes by more than ``tolerance`` of itself.

    ``matches`` are ``(a, b, score)`` with a's score from 0 to 1. They are summed to one
    row a pair first, so a round costs by the pairs that met, not by the matches. Strengths
    that do not settle within ``rounds`` are an error: some players never won, or never lost, against the rest."""
    scratch = Scratch(matches.sparkSession, "strengths")
    both = matches.where("a <> b").select("a", "b", "score").unionByName(matches.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), (1 - F.col("score")).alias("score")))
    pairs = scratch.save(both.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("score").alias("won")), "pairs")
    now = pairs.select(F.col("a").alias("player")).distinct().withColumns({"strength": F.lit(1.0), "before": F.lit(1.0)})
    now = scratch.save(now, "round-0")
    for k in range(1, rounds + 1):
        mine = now.select(F.col("player").alias("a"), F.col("strength").alias("p"))
        other = now.select(F.col("player").alias("b"), F.col("strength").alias("q"))
        raw = pairs.join(mine, "a").join(other, "b").groupBy(F.col("a").alias("player")).agg(
            (F.sum("won") / F.sum(F.col("n") / (F.col("p") + F.col("q")))).alias("s"), F.first("p").alias("before")
        )
        level = raw.agg(F.avg("s").alias("mean"))
        now = scratch.save(raw.crossJoin(F.broadcast(level)).select("player", (F.col("s") / F.col("mean")).alias("strength"), "before"), f"round-{k}")
        scratch.drop(f"round-{k - 1}")
        if now.where(F.abs(F.col("strength") - F.col("before")) > tolerance * F.col("before")).isEmpty():
            return now.drop("before")
    raise ArithmeticError(f"strengths have not settled after {rounds} rounds")


def first_distinct_answers(samples: DataFrame, prompt: str, answer: str, order: str, top: int) -> DataFrame:
    """Each prompt's first ``top`` distinct answers in sample order: ``(prompt, rank, answer)``."""
    seen = samples.groupBy(prompt, answer).agg(F.min(order).alias("_o"))
    rank = F.row_number().over(Window.partitionBy(prompt).orderBy("_o", answer))
    return seen.withColumn("rank", rank).where(F.col("rank") <= top).select(prompt, "rank", answer)


def mixture_plan(sources: DataFrame, total: int, synthetic_cap: float) -> DataFrame:
    """Sources ``(source, weight, tokens, synthetic)`` to whole tokens to draw and epochs.

    No source gives more than it has; synthetic sources over their cap are scaled down."""
    drawn = F.least((F.lit(float(total)) * F.col("weight")).cast("long"), F.col("tokens").cast("long"))
    plan = sources.select("source", "synthetic", drawn.alias("sampled"), (F.lit(float(total)) * F.col("weight") / F.greatest("tokens", F.lit(1))).alias("epochs"))
    made = plan.agg(F.coalesce(F.sum(F.when(F.col("synthetic"), F.col("sampled"))), F.lit(0)).alias("made"))
    cap = int(total * synthetic_cap)
    cut = F.col("synthetic") & (F.col("made") > cap)
    return plan.crossJoin(F.broadcast(made)).select("source", F.when(cut, (F.col("sampled") * (F.lit(float(cap)) / F.col("made"))).cast("long")).otherwise(F.col("sampled")).alias("sampled"), "epochs")
