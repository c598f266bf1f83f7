"""Exact quantiles, bounded cells and suffix arrays against plain versions."""

import math
import random

import numpy as np
import pytest

from millrace.functions.graders import prefix_scores, repetition
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.semantic import bounded_cells, semantic_links


@pytest.mark.parametrize("buckets", [16, 1024])
def test_quantiles(spark, buckets):
    rng = random.Random(2)
    make = [lambda: rng.gauss(0, 1), lambda: float(rng.randint(0, 3)), lambda: 10 ** rng.uniform(-90, 90), lambda: -1.5]
    rows = [(g, rng.choice([None, "a"]), make[g % 4]()) for g in range(4) for _ in range(400)]
    rows += [(9, "a", None), (9, "a", float("nan")), (9, "b", 4.0), (None, "a", 1.0), (None, "a", 2.0), (0, None, float("inf")), (8, "a", -1.7e308), (8, "a", 1.7e308)]
    df = spark.createDataFrame(rows, "g int, h string, x double")
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {(r.g, r.h, r.prob): r.value for r in exact_quantiles(df, "x", probs, ["g", "h"], buckets).collect()}
    by = {}
    for g, h, x in rows:
        if x is not None and math.isfinite(x):
            by.setdefault((g, h), []).append(x)
    assert {k[:2] for k in got} == by.keys() and len(got) == len(by) * len(probs)
    for (g, h), xs in by.items():
        for p in probs:
            xs.sort()
            at = p * (len(xs) - 1)
            lo, hi = xs[math.floor(at)], xs[math.ceil(at)]
            want = lo + (hi - lo) * (at - math.floor(at))
            assert got[g, h, p] == want or math.isclose(got[g, h, p], want, rel_tol=1e-12)
    assert [r.value for r in exact_quantiles(df.where("g = 9"), "x", [0.5]).collect()] == [4.0]
    assert exact_quantiles(df.limit(0), "x", [0.5]).count() == 0


def test_cells_and_links(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 16))
    m = centres[rng.integers(0, 3, 900)] + rng.normal(size=(900, 16)) * 0.4
    m[400:420] = m[0]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(900, [0.0] * 16), (901, None), (902, [float("nan")] * 16), (903, [None] * 16), (None, m[1].tolist()), (904, (m[0] * 3).tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    cells = bounded_cells(df, "id", "v", cells=4, leaf=60).cache()
    got = {r.id: r for r in semantic_links(cells, 0.9).collect()}
    assert got.keys() == {*range(900), 904}
    cell = {i: r.cell for i, r in got.items()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i in got}
    of = {}
    for i, c in cell.items():
        of.setdefault(c, []).append(i)
    for c, own in of.items():
        reps = {got[i].rep for i in own}
        assert len(reps) == got[own[0]].cell_size <= 60
        assert got[own[0]].compared + got[own[0]].skipped == len(reps) * (len(reps) - 1) // 2
        for i in own:
            assert got[i].n_links == sum(j != i and (got[j].rep == got[i].rep or unit[i] @ unit[j] > 0.9) for j in own)
    assert all(got[i].rep == 0 for i in range(400, 420))
    assert sum(r.skipped for r in semantic_links(cells, 0.999).collect()) > 0
    assert semantic_links(bounded_cells(df.limit(0), "id", "v"), 0.9).count() == 0


def test_suffix_arrays(spark):
    def plain(t):
        n = len(t)
        order, total = sorted(range(n), key=lambda i: t[i:]), 0
        for a, b in zip(order, order[1:]):
            k = 0
            while a + k < n and b + k < n and t[a + k] == t[b + k]:
                k += 1
            total += k
        return 2 * total / (n * (n + 1)) if n > 1 else 0.0

    rng = random.Random(1)
    texts = ["", "a", "aa", "ab", "aaaaaaaa", "abab" * 20, "é𝄞é𝄞", "\0\0a\0"] + ["".join(rng.choices("abc ", k=rng.randint(0, 300))) for _ in range(200)]
    assert np.allclose(prefix_scores(texts), [plain(t) for t in texts], rtol=0, atol=1e-12)
    long = "word " * 20_000
    rows = [(i, t) for i, t in enumerate([*texts, None, long, long[:-1] + "!"])]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, t string").select("i", repetition("t").alias("s")).collect()}
    assert all(math.isclose(got[i], plain(t), abs_tol=1e-12) for i, t in enumerate(texts)) and got[len(texts)] is None and got[len(texts) + 1] > 0.9
