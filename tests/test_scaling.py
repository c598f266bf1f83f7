import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import formats as X
from millrace.operators import checks as K
from millrace.operators import preferences as P
from millrace.operators import scaling as L


def test_formats(spark):
    texts = ["Größe, ÉTÉ!  x", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.f for r in d.select("doc_id", X.folded("text").alias("f")).orderBy("doc_id").collect()] == ["große ete x", "", None]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.split_digits(F.lit("a12345 6"))) == "a1 2 3 4 5 6" and one(X.split_digits(F.lit("1234567 12"), 3)) == "123 456 7 12"
    assert [one(X.short_number(F.lit(n))) for n in (999, 1000, 1500, 124_000_000, 10**12)] == ["999", "1K", "1.5K", "124M", "1T"]
    assert one(X.short_number(F.lit(1536), X.BINARY)) == "1.5KiB" and one(X.preview(F.lit("a b, c"), 3)) == "a b ,"
    assert one(X.is_safe(F.lit(" TRUE: bad"))) is False and one(X.instruction_prompt(F.lit("i"), F.lit("r"))).endswith("### Instruction:\ni\n\n### Response:\nr")


def test_laws(spark):
    rng = np.random.default_rng(1)
    n, d = 10 ** rng.uniform(6, 9, 60), 10 ** rng.uniform(8, 11, 60)
    e = np.linspace(0.05, 1.0, 80)[[24, 20]]
    y = 1.7 + 300 * n ** -e[0] + 400 * d ** -e[1]
    rows = list(zip(n.tolist(), d.tolist(), y.tolist()))
    runs = spark.createDataFrame([*rows, (None, 1.0, 1.0), (0.0, 1.0, 1.0)], "parameters double, tokens double, loss double")
    got = L.joint_law_fit(runs).first()
    assert (got.alpha, got.beta) == pytest.approx(tuple(e)) and got.floor == pytest.approx(1.7, abs=1e-2) and got.rmse < 1e-5
    assert L.joint_law_fit(runs.limit(0)).count() == 0
    x = np.arange(1, 60.0)
    noisy = 1 + 5 * x**-0.4
    noisy[7] *= 40
    fit = L.robust_power_law(spark.createDataFrame(list(zip(x.tolist(), noisy.tolist())), "x double, y double"), "x", "y", floor=1.0, delta=0.05).first()
    assert fit.exponent == pytest.approx(0.4, rel=0.05) and fit.coefficient == pytest.approx(5, rel=0.05)
    with pytest.raises(ValueError):
        L.robust_power_law(spark.createDataFrame([(1.0, 1.0)], "x double, y double"), "x", "y", floor=1.0)
    best = spark.range(1).select(L.compute_optimum(F.lit(1e22)).alias("o")).first().o
    assert best.parameters == pytest.approx(9.13e9, rel=1e-2) and 6 * best.parameters * best.tokens == pytest.approx(1e22)


def test_preferences(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    got = one(P.clipped_objective(F.lit(1.0), lit([0.0, 1.0]), lit([0.0, 0.0])))
    assert got.loss == pytest.approx([-1.0, -1.2]) and got.clip_fraction == 0.5
    whole = one(P.clipped_objective(F.lit(1.0), lit([0.0, 0.1, 9.0]), lit([0.0, 0.0, 0.0]), mask=lit([1, 1, 0])))
    assert whole.loss == pytest.approx([-math.exp(0.05)] * 3)
    assert one(P.preference_loss(*map(F.lit, (0.0, 0.0, 0.0, 0.0)))).loss == pytest.approx(math.log(2))
    seq = spark.createDataFrame([([1.0, 2.0, 9.0], [1, 1, 0]), ([4.0], [1])], "l array<double>, m array<int>")
    assert P.masked_means(seq, "l", "m").first().loss == 2.75 and P.masked_means(seq, "l", "m", 2.0).first().loss == 3.5
    games = spark.createDataFrame([("a", "b", 1.0)] * 3 + [("b", "a", 1.0)], "a string, b string, score double")
    power = {r.player: r.strength for r in P.bradley_terry(games, 12).collect()}
    assert power["a"] / power["b"] == pytest.approx(3, rel=1e-3)


def test_checks(spark):
    pages = spark.createDataFrame([(1, "http://a.bad.org/x"), (2, "http://notbad.org"), (3, None), (4, "https://bad.org")], "page_id long, url string")
    listed = K.listed_hosts(pages, spark.createDataFrame([("bad.org",), ("",)], "domain string"), "page_id").collect()
    assert {r.page_id for r in listed if r.listed} == {1, 4} and len(listed) == 4
    gaps = K.numbering_gaps(spark.createDataFrame([("k", 1), ("k", 1), ("k", 4), ("j", 2)], "k string, n long"), "k", "n").collect()
    assert [tuple(r) for r in gaps] == [("k", 2, 3)]
    d = spark.createDataFrame([("# Intro\ntext",), (None,)], "t string").select(K.missing_sections(F.col("t"), {"start": ("# Intro", "# Start"), "end": ("# End",)}).alias("m"))
    assert [r.m for r in d.collect()] == [["end"], ["start", "end"]]
    texts = spark.createDataFrame([(1, "[a](x.md) [b](http://z) [c](#q) [d](y.md#p)"), (2, None)], "i long, t string")
    assert [tuple(r) for r in K.broken_links(texts, spark.createDataFrame([("x.md",)], "path string"), "i", "t").collect()] == [(1, "y.md")]


def test_floor_law(spark):
    from millrace.operators.scaling import floor_law_fit

    for floor, c, e in ((1.7, 400.0, 0.34), (0.0, 12.0, 0.5)):
        rows = [(10.0**k, floor + c * 10.0 ** (-e * k)) for k in (2, 2.5, 3, 3.5, 4, 5, 6, 7)] + [(None, 1.0), (5.0, None), (0.0, 3.0), (-1.0, 3.0)]
        got = floor_law_fit(spark.createDataFrame(rows, "x double, y double"), "x", "y", seed=1).first()
        assert abs(got.floor - floor) < 1e-6 and abs(got.coefficient / c - 1) < 1e-5 and abs(got.exponent - e) < 1e-6
    assert floor_law_fit(spark.createDataFrame([], "x double, y double"), "x", "y").count() == 0


def test_elo_of_several_components(spark):
    import random

    from millrace.operators.analytics import elo

    rng = random.Random(2)
    rows = [(at, *rng.sample([f"{g}{i}" for i in range(4)], 2), rng.choice([0.0, 0.5, 1.0])) for at in range(300) for g in [rng.choice("xyz")]]
    rating = {}
    for at, a, b, s in rows:
        x, y = rating.get(a, 1000.0), rating.get(b, 1000.0)
        e = 1 / (1 + 10 ** ((y - x) / 400))
        rating[a], rating[b] = x + 32 * (s - e), y - 32 * (s - e)
    df = spark.createDataFrame(rows, "at long, a string, b string, score double")
    got = {r.player: r.rating for r in elo(df).collect()}
    assert got.keys() == rating.keys() and all(abs(got[p] - rating[p]) < 1e-9 for p in got)
    assert elo(df.limit(0)).count() == 0
