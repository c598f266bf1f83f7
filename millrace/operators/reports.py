"""Reports over runs and benchmarks: joins with baselines, summaries, funnels, answer scores."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.functions.text import let
from millrace.plans.scratch import Scratch

def baseline_against_strongest(df: DataFrame, key: str, variant: str, value: str, baseline: str) -> DataFrame:
    """``(key, value_baseline, value_strongest, strongest, ratio)``: the baseline's value beside the
    largest of all variants (ties to the first name), for keys that have both."""
    v = F.col(value)
    first = F.struct(~F.isnan(v.cast("double")), -v, F.col(variant).isNull(), variant)
    # one aggregation: values that are made twice, say sums of doubles, need not be equal
    each = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.collect_list(F.when(F.col(variant) == baseline, F.struct(v.alias("v")))).alias("base"),
        F.max(v).alias(f"{value}_strongest"), F.min_by(variant, F.when(v.isNotNull(), first)).alias("strongest"),
    )
    got = each.where(F.col(f"{value}_strongest").isNotNull()).select(key, F.explode("base.v").alias(f"{value}_baseline"), f"{value}_strongest", "strongest")
    return got.withColumn("ratio", F.col(f"{value}_strongest") / F.col(f"{value}_baseline"))


def speedups(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Old and new values of the keys that both have, and how many times faster the new one is."""
    return old.select(*keys, F.col(value).alias("old")).join(new.select(*keys, F.col(value).alias("new")), keys).withColumn("speedup", F.try_divide(F.col("old"), F.col("new")))


def zipped(left: Column, right: Column) -> Column:
    """Structs ``i, left, right`` of two arrays by position; arrays of unequal length are an error."""
    same = F.when(F.size(left) == F.size(right), left).otherwise(F.raise_error(F.lit("the lists differ in length")).cast("array<string>"))
    return F.transform(F.arrays_zip(same.alias("l"), right.alias("r")), lambda x, i: F.struct(i.alias("i"), x["l"].alias("left"), x["r"].alias("right")))


def last_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each group; an aggregate, not a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l")).select(*keys, "_l.*")


def mean_and_deviation(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means and sample deviations; the deviation of one row is null."""
    return df.groupBy(*keys).agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def sweep_summary(df: DataFrame, key: str, loss: str, tokens: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(loss).alias("least_loss"), F.max(tokens).alias("most_tokens"))


def least_coverage(df: DataFrame, tier: str) -> DataFrame:
    """The number of rows of the tier that has the fewest."""
    return df.groupBy(tier).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.count("*").alias("tiers"))


def throughput(df: DataFrame, n_bytes: str, n_tokens: str, seconds: float, corpus_bytes: float = 825e9) -> DataFrame:
    """Bytes a token, bytes a second, and the hours a corpus of ``corpus_bytes`` would take."""
    total = df.agg(F.sum(n_bytes).alias("n_bytes"), F.sum(n_tokens).alias("n_tokens"))
    rate = F.col("n_bytes") / seconds
    return total.select("*", F.try_divide(F.col("n_bytes"), F.col("n_tokens")).alias("bytes_per_token"), rate.alias("bytes_per_second"), (F.lit(corpus_bytes) / rate / 3600).alias("corpus_hours"))


def relative_errors(df: DataFrame, value: str, reference: str, floor: float = 1e-12) -> DataFrame:
    """The 99 % quantile of the relative error (from a mergeable sketch) and the largest absolute one."""
    off = F.abs(F.col(value) - F.col(reference))
    return df.agg(F.percentile_approx(off / F.greatest(F.abs(F.col(reference)), F.lit(floor)), 0.99, 100_000).alias("p99_relative"), F.max(off).alias("max_absolute"))


def utc_stamp(ts: Column) -> Column:
    """ISO 8601 with microseconds and the offset of UTC, of a time without a zone."""
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def log_softmax(x: Column) -> Column:
    """Of an array, with the largest value taken out first."""
    whole = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    shifted = lambda a, top: F.transform(a, lambda v: v.cast("double") - top)
    less = lambda a: let(F.log(whole(F.transform(a, lambda w: F.exp(w)))), lambda z: F.transform(a, lambda v: v - z))
    return let(F.array_max(x).cast("double"), lambda top: let(shifted(x, top), less))


def entropy(logits: Column) -> Column:
    return let(log_softmax(logits), lambda p: -F.aggregate(p, F.lit(0.0), lambda acc, v: acc + F.exp(v) * v))


def registry_faults(df: DataFrame, id_col: str, rules: dict[str, Column], unique: tuple[str, ...]) -> DataFrame:
    """``(id, fault)``: broken rules (a null outcome breaks one too), and values that several rows share."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    found = df.select(F.col(id_col).cast("string").alias("id"), F.explode(broken).alias("fault"))
    for c in unique:
        again = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("id")).agg(F.count("*").alias("n")).where("n > 1")
        found = found.unionByName(again.select("id", F.lit(f"duplicate {c}").alias("fault")))
    return found


def funnel(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """``(stage, n, share)``: rows by the first test they fail, or ``retained``, and their share of all."""
    stage = F.lit("retained")
    for name, ok in reversed(tests.items()):
        stage = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(stage)
    counts = df.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("stage", "n", (F.col("n") / F.col("all")).alias("share"))


def plain_words(text: Column) -> Column:
    """Lower case, without punctuation, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def chosen_option(response: Column, options: Column) -> Column:
    """The letter a response names as a word, else the letter of the first option whose text it holds;
    options are an array of structs ``letter, text`` in order."""
    said = plain_words(response)
    letter = F.filter(options, lambda o: F.array_contains(F.split(said, " "), F.lower(o["letter"])))
    text = F.filter(options, lambda o: (plain_words(o["text"]) != "") & F.contains(said, plain_words(o["text"])))
    return F.coalesce(F.get(letter, F.lit(0))["letter"], F.get(text, F.lit(0))["letter"])


def circular_scores(rotations: DataFrame, item: str) -> DataFrame:
    """Rotations ``(item, response, options, gold)`` to ``(item, score)``: 1 if the text of the chosen
    option is the gold text in every rotation."""
    text_of = lambda letter: F.get(F.filter("options", lambda o: o["letter"] == letter), F.lit(0))["text"]
    picked = chosen_option(F.col("response"), F.col("options"))
    right = F.coalesce(plain_words(text_of(picked)) == plain_words(text_of(F.col("gold"))), F.lit(False))
    return rotations.select(item, right.alias("right")).groupBy(item).agg(F.bool_and("right").cast("double").alias("score"))


def special_split(text: Column, specials: tuple[str, ...]) -> Column:
    """Pieces of a text with the special strings kept as pieces, the longest first where they overlap."""
    import re

    if not specials:
        return F.filter(F.array(text), lambda p: p != "")
    longest = "|".join(re.escape(s).replace(r"\ ", " ") for s in sorted(dict.fromkeys(specials), key=len, reverse=True))
    return F.filter(F.split(F.regexp_replace(text, f"({longest})", "\x01$1\x01"), "\x01", -1), lambda p: p != "")


def collated(prompt: Column, response: Column, eos: int, pad: int, length: int) -> Column:
    """Struct ``input_ids, labels, attention`` of ``length`` places: the response and ``eos`` are labels,
    prompt and padding are -100; what is longer is cut."""
    whole = F.concat(prompt, response, F.array(F.lit(eos)))
    labels = F.concat(F.transform(prompt, lambda _: F.lit(-100)), response, F.array(F.lit(eos)))
    fill = lambda a, v: F.slice(F.concat(a, F.array_repeat(F.lit(v), length)), 1, length)
    return F.struct(fill(whole, pad).alias("input_ids"), fill(labels, -100).alias("labels"), fill(F.transform(whole, lambda _: F.lit(1)), 0).alias("attention"))


def within_budget(df: DataFrame, start: str, size: str, budget: int, order: str) -> DataFrame:
    """One row: the number of whole items that ``budget`` reaches, the tokens of these, and what is
    left for the item after them. ``start`` is the sum of the sizes before an item."""
    done = (F.col(start) + F.col(size)) <= budget
    one = df.agg(F.count_if(done).alias("completed"), F.max(F.when(done, F.col(start) + F.col(size))).alias("t"), F.sum(size).alias("all"))
    tokens = F.coalesce("t", F.lit(0)).cast("long")
    return one.select("completed", tokens.alias("tokens"), (F.least(F.coalesce("all", F.lit(0)), F.lit(budget)) - tokens).cast("long").alias("partial"))


def free_floor_fit(points: DataFrame, x: str, y: str, floors: list[float]) -> DataFrame:
    """``(floor, coefficient, exponent, sse)`` of y = floor + c * x ** e: each floor below all y is a start,
    fitted by least squares of the logs in one scan; the one of least squared error in the logs wins."""
    lx = F.log(F.col(x))
    fits = []
    for i, f in enumerate(floors):
        ly = F.log(F.when(F.col(y) > f, F.col(y) - f))
        sse = F.regr_syy(ly, lx) - F.pow(F.regr_sxy(ly, lx), 2) / F.regr_sxx(ly, lx)
        fits.append(F.struct(F.lit(float(f)).alias("floor"), F.exp(F.regr_intercept(ly, lx)).alias("coefficient"), F.regr_slope(ly, lx).alias("exponent"),
                             sse.alias("sse"), (F.min(F.col(y)) > f).alias("fits")).alias(f"f{i}"))
    one = points.agg(*fits)
    return one.select(F.explode(F.array(*[f"f{i}" for i in range(len(floors))])).alias("x")).select("x.*").where("fits").drop("fits").orderBy("sse", "floor").limit(1)


MOST_SUBSETS = 64


def agreement_duplicates(signatures: DataFrame, hashes: int, bands: int, threshold: float, id_col: str = "doc_id") -> DataFrame:
    """Ids whose signature agrees in ``threshold`` of its places with that of a lesser id which shares a band; one signature an id.

    Two signatures agree in so many places exactly if they are equal on some set of so many; where
    the other places are fewer than bands, a band is then shared. So an id is no duplicate if it is
    the least of its group on every such set of places, which takes a row a set and no pairs."""
    need = max(0, math.ceil(threshold * hashes))
    if hashes - need >= bands or math.comb(hashes, need) > MOST_SUBSETS:
        return _agreement_by_bands(signatures, hashes, bands, threshold, id_col)
    scratch = Scratch(signatures.sparkSession, "agreement")
    own = scratch.save(signatures.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *[f"h{i}" for i in range(hashes)]), "signatures")
    places = list(itertools.combinations(range(hashes), need))
    keys = F.array(*[F.struct(F.lit(k).alias("places"), *[F.col(f"h{i}").alias(f"v{j}") for j, i in enumerate(at)]) for k, at in enumerate(places)])
    least = own.select("id", F.explode(keys).alias("key")).select("id", "key.*").groupBy("places", *[f"v{j}" for j in range(need)]).agg(F.min("id").alias("id"))
    heads = least.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(places))
    return own.select("id").join(heads.select("id"), "id", "left_anti")


def _agreement_by_bands(signatures: DataFrame, hashes: int, bands: int, threshold: float, id_col: str) -> DataFrame:
    """The same for any bands: equal signatures are one node, whose later ids all count. Between nodes, only the
    earliest id of each is compared, in blocks of a band's bucket."""
    from millrace.operators.curation import BUCKET_BLOCK

    sig = F.array(*[f"h{i}" for i in range(hashes)])
    own = signatures.select(F.col(id_col).alias("id"), sig.alias("sig"))
    nodes = own.groupBy("sig").agg(F.min("id").alias("id"))
    later = own.join(nodes.withColumnRenamed("id", "first"), "sig").where("id > first").select("id")
    rows = hashes // bands
    keys = F.array(*[F.struct(F.lit(b).alias("band"), F.slice("sig", b * rows + 1, rows).alias("values")) for b in range(bands)])
    posted = nodes.select("id", "sig", F.explode(keys).alias("bucket"))
    sizes = posted.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    posted = posted.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("size") / BUCKET_BLOCK).cast("long")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = posted.select("bucket", F.col("block").alias("a"), each.alias("b"), F.col("id").alias("x"), F.col("sig").alias("sx"))
    right = posted.select("bucket", each.alias("a"), F.col("block").alias("b"), F.col("id").alias("y"), F.col("sig").alias("sy"))
    agree = F.size(F.filter(F.zip_with("sx", "sy", lambda p, q: p == q), lambda e: e))
    return left.join(right, ["bucket", "a", "b"]).where((F.col("x") < F.col("y")) & (agree >= threshold * hashes)).select(F.col("y").alias("id")).unionByName(later).distinct()


def position_listing(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows in order, numbered from 1: a top-k whose rows alone are ranked."""
    return df.orderBy(*order).limit(limit).withColumn("position", F.row_number().over(Window.orderBy(*order)))
