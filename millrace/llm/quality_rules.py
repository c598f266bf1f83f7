"""Quality rules: fixed base rules, then robust multivariate outliers.

Each text becomes a vector of transformed statistics. Per language and source, a
minimum-covariance-determinant estimate gives a centre and a covariance that a minority
of bad rows cannot move, and rows far from it by Mahalanobis distance are rejected.
A group's estimate is drawn towards its language's, and that towards the whole table's,
with the weight of ``prior_rows`` rows: a group of any size is judged by one formula.
All of it is DataFrame functions; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._expr import let, words_of
from millrace.plans.scratch import Scratch, join_small

WINDOW = 8
DIMS = ("x0", "x1", "x2", "x3")
# Least standard deviations of the dimensions: below these, spread is not evidence.
FLOORS = (0.7, 0.7, 0.5, 0.15)


def repeated_window_words(words: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of ``size`` words found twice or more in the array."""

    def covered(hashes: Column) -> Column:
        def spots(sorted_: Column) -> Column:
            near = lambda i: F.get(sorted_, i)["h"]
            last = F.size(sorted_) - 1
            hit = F.filter(
                sorted_,
                lambda x, i: (i > 0) & (near(i - 1) == x["h"]) | (i < last) & (near(i + 1) == x["h"]),
            )
            return let(
                F.array_sort(F.transform(hit, lambda x: x["i"])),
                lambda at: F.aggregate(
                    F.transform(at, lambda p, k: F.when(k == 0, F.lit(size)).otherwise(F.least(F.lit(size), p - F.get(at, k - 1)))),
                    F.lit(0).cast("long"),
                    lambda acc, x: acc + x,
                ),
            )

        same = F.size(F.array_distinct(hashes)) == F.size(hashes)
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(same, F.lit(0).cast("long")).otherwise(let(pairs, spots))

    def windows(one: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(one) - (size - 1))
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(one, i, size))), covered)

    return F.when(F.size(words) < size, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), windows))


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    A null text has none of anything. Windows are compared by 64-bit hashes. Existing
    columns of these names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    with_word = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = F.struct(
        F.col("_w").getField("n").alias("n_words"),
        F.col("_w").getField("chars").alias("word_chars"),
        F.size(F.regexp_extract_all(text, F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
        let(with_word, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")).alias("n_dup_lines"),
        F.col("_w").getField("repeat").alias("n_repeat_words"),
    )
    per_word = let(
        words_of(F.col(text_col)),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n"),
            F.length(F.array_join(ws, "")).cast("long").alias("chars"),
            repeated_window_words(ws).alias("repeat"),
        ),
    )
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"}
    return docs.withColumn("_w", per_word).withColumn("_s", out).select(*[c for c in docs.columns if c not in new], "_s.*")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def _vector() -> list[Column]:
    """Log length, mean word length, symbol rate and repeated share, each on a scale on
    which clean text is roughly symmetric."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n),
        F.col("word_chars") / n,
        F.log1p(100.0 * F.col("n_symbols") / n),
        F.asin(F.sqrt(F.least(F.lit(1.0), (F.col("n_repeat_words") / n + F.col("n_dup_lines") / n) / 2))),
    ]


P = len(DIMS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
STARTS = ("sum", "largest", "wrapped")
# Fixed value: makes the covariance of the nearest three quarters of normal rows that of all
# rows in four dimensions, 0.75 / P(chi2 with 6 degrees <= 0.75 quantile of chi2 with 4).
SUPPORT, CONSISTENCY = 0.75, 1.4864156


def _moments(rows: DataFrame, starts: tuple[str, ...]) -> DataFrame:
    """Per group and start the size, mean and covariance of the rows within the start's edge."""
    aggs, out = [], ["grp", "above"]
    for s in starts:
        within = lambda x, s=s: f"if(d_{s} <= edge_{s}, {x}, null)"
        aggs += [f"count({within(1)}) as n_{s}", *[f"sum({within(d)}) as s_{s}_{i}" for i, d in enumerate(DIMS)]]
        aggs += [f"sum({within(f'{DIMS[i]} * {DIMS[j]}')}) as q_{s}_{i}{j}" for i, j in PAIRS]
        out += [f"s_{s}_{i} / n_{s} as m_{s}_{i}" for i in range(P)]
        for i, j in PAIRS:
            spread = f"(q_{s}_{i}{j} - s_{s}_{i} * s_{s}_{j} / n_{s}) / greatest(n_{s} - 1, 1)"
            out.append(f"{CONSISTENCY}D * {f'greatest({spread}, 0D)' if i == j else spread} as c_{s}_{i}{j}")
    return rows.groupBy("grp", "above").agg(*map(F.expr, aggs)).selectExpr(*out)


def _with_factors(shapes: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """``shapes`` with the inverse Cholesky factors ``pairs[c]`` of the covariances ``c``, whose
    variances have floors, and ``logdet_c``, the logs of their determinants."""

    def steps(c: str, to: str) -> list[dict[str, str]]:
        """Columns by the round in which all they need is there."""
        low, out = f"_low_{c}", []
        dot = lambda a, i, b, j, ks: " + ".join(["0D", *[f"{a}_{i}{k} * {b}_{j(k)}" for k in ks]])
        cov = lambda i, j: f"greatest({c}_{i}{i}, {FLOORS[i] ** 2}D)" if i == j else f"{c}_{i}{j}"
        for j in range(P):
            under = lambda i, j=j: dot(low, i, low, lambda k: f"{j}{k}", range(j))
            out.append({f"{low}_{j}{j}": f"sqrt(greatest({cov(j, j)} - ({under(j)}), 1e-9D))"})
            out.append({f"{low}_{i}{j}": f"({cov(i, j)} - ({under(i)})) / {low}_{j}{j}" for i in range(j + 1, P)})
        for i in range(P):
            row = {f"{to}_{i}{j}": f"-({dot(low, i, to, lambda k, j=j: f'{k}{j}', range(j, i))}) / {low}_{i}{i}" for j in range(i)}
            out.append(row | {f"{to}_{i}{i}": f"1 / {low}_{i}{i}"})
        return [*out, {f"logdet_{c}": " + ".join(f"2 * ln({low}_{i}{i})" for i in range(P))}]

    out = shapes
    for together in zip(*[steps(c, to) for c, to in pairs.items()]):
        new = {name: F.expr(x) for own in together for name, x in own.items()}
        out = out.withColumns(new) if new else out
    return out.drop(*[f"_low_{c}_{i}{j}" for c in pairs for i, j in PAIRS])


def _distance(m: str, factor: str) -> Column:
    """Squared Mahalanobis distance: that of the vector times the inverse factor."""
    y = [" + ".join(f"{factor}_{i}{k} * ({DIMS[k]} - {m}_{k})" for k in range(i + 1)) for i in range(P)]
    return F.expr(" + ".join(f"pow({x}, 2)" for x in y))


def _first_distances(z: list[Column]) -> dict[str, Column]:
    """Three rankings of rows by their robust scores, one for each start."""
    return {
        "sum": sum((x * x for x in z[1:]), z[0] * z[0]),
        "largest": F.greatest(*[F.abs(x) for x in z]),
        "wrapped": sum((F.tanh(F.abs(x)) for x in z[1:]), F.tanh(F.abs(z[0]))),
    }


def mcd_shapes(rows: DataFrame, scratch: Scratch, steps: int = 3, max_broadcast_groups: int = 20_000) -> DataFrame:
    """Per ``grp`` of ``rows`` (with ``above``, which ``grp`` decides) its number of rows ``n`` and
    the centre ``m_i`` and covariance ``c_ij`` of least determinant.

    Each of ``STARTS`` ranks a group's rows by their scores against the coordinatewise median
    and interquartile range. Concentration steps then take the ``SUPPORT`` share of the rows
    that are nearest and estimate mean and covariance from them; with exact order statistics
    no step raises the determinant. Of the starts' ends the one of least determinant counts.
    Order statistics are mergeable sketches (exact below 10,000 rows a group), moments are
    partial sums: a group of any size is spread over all tasks.
    """
    q = F.percentile_approx
    quart = rows.groupBy("grp").agg(F.count("*").alias("n"), *[q(d, [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i, d in enumerate(DIMS)])
    quart = scratch.save(quart, "quartiles")
    first = join_small(rows, quart.drop("n"), ["grp"], max_broadcast_groups, "inner")
    z = [(F.col(d) - F.col(f"q{i}")[1]) / F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i])) for i, d in enumerate(DIMS)]
    now = first.select("grp", "above", *DIMS, *[x.alias(f"d_{s}") for s, x in _first_distances(z).items()])
    for k in range(steps + 1):
        edge = scratch.save(now.groupBy("grp").agg(*[q(f"d_{s}", SUPPORT, 10_000).alias(f"edge_{s}") for s in STARTS]), f"edge-{k}")
        core = join_small(now, edge, ["grp"], max_broadcast_groups, "inner")
        shape = scratch.save(_with_factors(_moments(core, STARTS), {f"c_{s}": f"l_{s}" for s in STARTS}), f"shape-{k}")
        if k < steps:
            joined = join_small(rows, shape.drop("above"), ["grp"], max_broadcast_groups, "inner")
            now = joined.select("grp", "above", *DIMS, *[_distance(f"m_{s}", f"l_{s}").alias(f"d_{s}") for s in STARTS])
    names = [*[f"m{{}}_{i}" for i in range(P)], *[f"c{{}}_{i}{j}" for i, j in PAIRS]]
    least = f"least({', '.join(f'logdet_c_{s}' for s in STARTS)})"
    best = lambda x: " ".join(["case", *[f"when logdet_c_{s} = {least} then {x.format(f'_{s}')}" for s in STARTS], "end as", x.format("")])
    return shape.join(quart.select("grp", "n"), "grp").selectExpr("grp", "above", "n", *map(best, names))


def _drawn(shapes: DataFrame, above: DataFrame, prior_rows: float) -> DataFrame:
    """``shapes`` drawn towards those of the group ``above``, whose weight is ``prior_rows`` rows."""
    names = [*[f"m_{i}" for i in range(P)], *[f"c_{i}{j}" for i, j in PAIRS]]
    up = above.selectExpr("grp as above", *[f"{x} as up_{x}" for x in names])
    own = f"(n / (n + {float(prior_rows)}D))"
    return shapes.join(up, "above").selectExpr("grp", "above", "n", *[f"{own} * {x} + (1 - {own}) * up_{x} as {x}" for x in names])


RESULTS = {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"}


def quality_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    prior_rows: float = 50.0, cutoff: float = 33.4, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Statistics, base verdict and final verdict of each row of ``docs``.

    A row fails the base rules with fewer than 20 words, or with over 30 % of its words
    in repeated windows. Of the rest, a row is rejected if its vector's squared robust
    distance within its language and source exceeds ``cutoff`` (the 1 - 1e-6 quantile of
    chi-squared with 4 degrees; far, so that ordinary long or short texts stay). Centre and
    covariance of a group of n rows count n / (n + ``prior_rows``), the rest is its
    language's, which is drawn towards the table's alike. Null tags form groups of their
    own, apart from empty ones. Repeated rows and null ids are judged as they come; an empty
    table gives an empty result. ``keep`` names columns to carry along, which may not be
    called as a result's.
    """
    if clash := RESULTS & set(keep) - {id_col}:
        raise ValueError(f"results have columns {sorted(clash)} already")
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    lang, source = F.col(lang_col).cast("string"), F.col(source_col).cast("string")
    groups = F.array(F.lit("[]"), F.to_json(F.array(lang)), F.to_json(F.array(lang, source)))
    carried = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"), groups.alias("_g"), F.struct(F.lit(0), *keep).alias("_row"))
    base = text_statistics(carried, "_t").drop("_t").withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    base = scratch.save(base.select("*", *[x.alias(d) for x, d in zip(_vector(), DIMS)]), "statistics")
    # a row counts in its own group, in its language and in the table
    levels = F.array(*[F.struct(F.get("_g", k).alias("grp"), F.get("_g", max(k - 1, 0)).alias("above")) for k in range(3)])
    fit = base.where("not base_failed").select(F.explode(levels).alias("x"), *DIMS).select("x.*", *DIMS)
    shapes = scratch.save(mcd_shapes(fit, scratch), "shapes")
    whole = shapes.where("grp = '[]'")
    by_lang = _drawn(shapes.where("above = '[]' and grp <> '[]'"), whole, prior_rows)
    own = _drawn(shapes.where("above <> '[]'"), by_lang, prior_rows)
    own = scratch.save(_with_factors(own, {"c": "l"}).drop("n", "above", "logdet_c").withColumnRenamed("grp", "_own"), "drawn")
    scored = join_small(base.withColumn("_own", F.get("_g", 2)), own, ["_own"], 20_000).withColumn("_d2", _distance("m", "l"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("_d2") <= cutoff, F.lit(True))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"),
        F.when(~F.col("base_failed"), F.col("_d2")).alias("distance"), *[F.col("_row")[c].alias(c) for c in keep if c != id_col],
    )
