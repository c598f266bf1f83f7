"""Exact quantiles by selection in refined histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from millrace.plans.scratch import Scratch

BUCKETS = 1024
SMALL = 20_000


def _scaled(x: str) -> Column:
    """A rising function of the value within its range: the logarithm of ranges of many decades, else the value (halved, as a span may overflow)."""
    size = F.greatest(F.abs("lo"), F.abs("hi"))
    decades = (F.least(F.abs("lo"), F.abs("hi")) * 1000 < size) | ((F.col("lo") < 0) & (F.col("hi") > 0))
    return F.when(decades, F.signum(F.col(x)) * F.log1p(F.abs(F.col(x)) / size * 1e12)).otherwise(F.col(x) / 2)


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``(by ..., prob, value)``: linearly interpolated quantiles of each group, any number of them.

    A group's rank is looked for in ranges of values. Each round reads the table once: the
    rows of every open range are counted in ``buckets`` parts, equal on a scale or its logarithm, with the parts' least and
    greatest values, and the part that holds the rank is the next round's range, cut down to
    those values; a range of one value is the answer. What is held is a row for each open
    part, whatever the number of rows, and a range that several ranks share is read once.

    Null, NaN and infinite values take no part, a group without others has no row. Groups may be
    null. The values are compared as doubles."""
    by = by or []
    scratch = Scratch(df.sparkSession, "quantiles")
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)] or [F.lit(0).alias("_g0")]
    named = [f"_g{i}" for i in range(len(keys))]
    code = [F.col(g).isNull().alias(f"{g}n") for g in named]  # a null group joins by its mark
    own = df.select(*keys, F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    own = own.select("*", *code)
    for g, f in zip(named, own.schema):
        own = own.withColumn(g, F.coalesce(g, F.lit("" if isinstance(f.dataType, T.StringType) else 0).cast(f.dataType)))
    group = [*named, *(f"{g}n" for g in named)]
    sizes = own.groupBy(*group).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    want = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.lit(k).alias("k")) for k, p in enumerate(probs)]))
    place = F.col("w.prob") * (F.col("n") - 1)
    ends = F.explode(F.array(F.floor(place).cast("long"), F.ceil(place).cast("long")))
    open_ = sizes.select("*", want.alias("w")).select(*group, "w.k", "lo", "hi", ends.alias("rank"), F.lit(0).cast("long").alias("below")).distinct()
    open_, k = scratch.save(open_, "open-0"), 0
    few = open_.count() <= SMALL  # and never more
    found = [open_.where("lo = hi")]
    while not (rest := open_.where("lo < hi")).isEmpty():  # the ends of a range fall in different parts, so each round narrows it
        ranges = rest.select(*group, "lo", "hi").distinct()
        inside = own.join(F.broadcast(ranges) if few else ranges, group).where(F.col("x").between(F.col("lo"), F.col("hi")))
        share = (_scaled("x") - _scaled("lo")) / (_scaled("hi") - _scaled("lo"))
        part = F.least(F.floor(share * buckets), F.lit(buckets - 1))
        counted = inside.groupBy(*group, "lo", "hi", part.alias("part")).agg(F.count("*").alias("c"), F.min("x").alias("least"), F.max("x").alias("most"))
        before = F.sum("c").over(Window.partitionBy(*group, "lo", "hi").orderBy("part")) - F.col("c")
        counted = counted.withColumn("before", before)
        at = F.col("rank") - F.col("below")
        step = rest.join(counted, [*group, "lo", "hi"]).where((at >= F.col("before")) & (at < F.col("before") + F.col("c")))
        k += 1
        open_ = scratch.save(step.select(*group, "k", F.col("least").alias("lo"), F.col("most").alias("hi"), "rank", (F.col("below") + F.col("before")).alias("below")), f"open-{k}")
        found.append(open_.where("lo = hi"))
    done = found[0]
    for more in found[1:]:
        done = done.unionByName(more)
    values = done.groupBy(*group, "k").agg(F.min("lo").alias("low"), F.max("lo").alias("high"))
    prob = F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("k"))
    place = prob * (F.col("n") - 1)
    out = values.join(sizes.select(*group, "n"), group).select(
        *[F.when(~F.col(f"_g{i}n"), F.col(f"_g{i}")).alias(c) for i, c in enumerate(by)], prob.alias("prob"),
        (F.col("low") + (F.col("high") - F.col("low")) * (place - F.floor(place))).alias("value"),
    )
    return out
