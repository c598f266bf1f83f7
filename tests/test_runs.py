"""Ordered runs against the sequential loop."""

import random

import numpy as np
import pytest

from millrace.operators.sequences import greedy_packs, ordered_runs


def plain(sizes, capacity):
    out, used, pack, held = [], 0, 0, False
    for n in sizes:
        if held and used + n > capacity:
            pack, used = pack + 1, 0
        held, used = True, used + n
        out.append(pack)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_those_of_the_loop(spark, seed):
    rng = random.Random(seed)
    big = [0, 1, 1, 2, 3, 5, 30, 200]
    rows = [(rng.choice(["a", "b", "b", "b", None, "c"]), i, rng.choice(big[seed:])) for i in range(3000)] + [("d", 1, None), ("e", 5, 7)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, o long, n long, other string")
    for block in (7, 64, 5000):
        got = {(r.k, r.o): r.pack for r in ordered_runs(df, "o", "n", 40, "k", block).collect()}
        want = {}
        for k in ("a", "b", "c", "d", "e", None):
            own = sorted((o, n or 0) for x, o, n in rows if x == k)
            want |= {(k, o): p for (o, _), p in zip(own, plain([n for _, n in own], 40))}
        assert got == want
        one = df.dropDuplicates(["o"])
        own = sorted((r.o, r.n or 0) for r in one.collect())
        assert [r.pack for r in ordered_runs(one, "o", "n", 40, None, block).orderBy("o").collect()] == plain([n for _, n in own], 40)


def test_few_items_in_a_pack_of_many_blocks(spark):
    df = spark.range(5000).selectExpr("id AS o", "1L AS n")
    got = ordered_runs(df, "o", "n", 1700, None, 50).groupBy("pack").count().orderBy("pack").collect()
    assert [r["count"] for r in got] == [1700, 1700, 1600]
    assert greedy_packs(df.limit(0).selectExpr("1L AS k", "o", "n"), "k", "o", "n", 9).count() == 0


def test_one_key_of_many_items(spark):
    df = spark.range(1_000_000).selectExpr("7L AS k", "id AS o", "pmod(xxhash64(id), 90) AS n")
    sizes = df.orderBy("o").toPandas()["n"].to_numpy()
    got = greedy_packs(df, "k", "o", "n", 400).orderBy("o").toPandas()["pack"].to_numpy()
    assert (got == np.array(plain(sizes.tolist(), 400))).all()
