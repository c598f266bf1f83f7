"""What operators do as their tables grow: points read once, groups cut into parts, values made twice."""

import pandas as pd

from millrace.operators import reports as R
from millrace.operators.scaling import floor_law_fit
from millrace.streaming import events as E
from millrace.streaming import lifecycle as L


def test_points_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    points = spark.range(1, 21).selectExpr("double(id) as x", "5 + 7 * pow(double(id), -0.5) as y").mapInPandas(count, "x double, y double")
    fit = floor_law_fit(points, "x", "y").first()
    assert abs(fit.exponent - 0.5) < 1e-4 and fit.rounds > 1 and made.value == 20


def _drained(spark, tmp_path, rows, columns, machine):
    """Rows of one batch, in Arrow batches of seven."""
    pd.DataFrame(rows, columns=columns).to_parquet(f"{tmp_path}/e.parquet")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        schema = spark.read.parquet(f"{tmp_path}/e.parquet").schema
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "e.parquet").parquet(str(tmp_path))
        return E.drain(machine(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint").orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_states_of_groups_in_parts(spark, tmp_path):
    steps = ["queued", "running", "failed"] + ["queued"] * 37
    rows = [(i, 1, i, s) for i, s in enumerate(steps)][::-1]
    got = _drained(spark, tmp_path, rows, ["id", "entity", "at", "state"], E.state_machine)
    assert [r.before for r in got] == ["new", "queued", "running"] + ["failed"] * 37


def test_lifecycle_of_groups_in_parts(spark, tmp_path):
    steps = ["queued", "running"] + ["val_loss"] * 37 + ["completed"]
    rows = [(i, 1, i, s, "r") for i, s in enumerate(steps)][::-1]
    got = _drained(spark, tmp_path, rows, ["id", "entity", "at", "kind", "run_id"], L.run_lifecycle)
    assert [r.before for r in got] == ["new", "queued"] + ["running"] * 38 and all(r.accepted for r in got)


def test_strongest_of_values_made_anew(spark):
    """A value that differs in its last digits each time it is made."""
    import random

    def shaken(batches):
        for b in batches:
            yield b.assign(x=b["x"] + [random.random() * 1e-6 for _ in range(len(b))])

    rows = spark.range(60).selectExpr("concat('k', id % 20) as k", "concat('v', id div 20) as v", "double(id) as x")
    shaky = rows.mapInPandas(shaken, "k string, v string, x double")
    got = R.baseline_against_strongest(shaky, "k", "v", "x", "v0").collect()
    assert len(got) == 20 and all(r.strongest == "v2" for r in got)
    ties = spark.createDataFrame([("a", "w", 2.0), ("a", "v", 2.0), ("a", "b", 1.0), ("a", "n", None), ("c", "b", None)], "k string, v string, x double")
    assert [tuple(r) for r in R.baseline_against_strongest(ties, "k", "v", "x", "b").collect()] == [("a", 1.0, 2.0, "v", 2.0)]


def test_links_at_the_threshold(spark):
    """Pairs at exactly 0.8, of which affine bands lost many."""
    from millrace.operators.curation import minhash_dedup

    lost = [385, 529, 596, 660, 919, 1111, 1375, 1681, 2107, 2185]
    near = [" ".join([f"w{t}x{j}" for j in range(12)] + [end]) for t in lost for end in (f"w{t}x12", f"v{t}")]
    below = [" ".join([f"u{t}x{j}" for j in range(11)] + ends) for t in lost for ends in (["a", "b"], ["c", "d"])]
    rows = [(i, t) for i, t in enumerate([*near, *below, "", None, " . "])]
    got = {r.doc_id: (r.root, r.kept) for r in minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: i - i % 2 if i < 20 else 40 if i >= 40 else i for i in range(43)}
    assert got == {i: (r, i == r) for i, r in want.items()}


def _linked_texts():
    """Texts that share a passage, some above the threshold and some below, with copies and repeated ids."""
    import random

    rng = random.Random(5)
    words = lambda name, n: [f"{name}x{j}" for j in range(n)]
    texts = [" ".join(words("p", 60) + words(f"t{i}", rng.choice([2, 6, 12, 20, 60]))) for i in range(60)]
    texts += [x + " one more" for x in texts[:30]] + texts[:10] + [" ".join(words(f"u{i}", 40)) for i in range(300)]
    return [(i if i < 90 else i - 5, t) for i, t in enumerate(texts)]


def _roots(rows, k=5):
    """Brute force: the least id of each distinct text's group; ids may repeat."""
    sets = {}
    for i, t in rows:
        w = t.split()
        s = frozenset(" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1)))
        sets.setdefault(s, []).append(i)
    nodes, parent = list(sets), {s: s for s in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in enumerate(nodes):
        for y in nodes[:a]:
            both = len(x & y)
            if 5 * both >= 4 * (len(x) + len(y) - both):
                parent[find(x)] = find(y)
    least = {}
    for s, ids in sets.items():
        least[find(s)] = min([least.get(find(s), 10**9), *ids])
    return sorted((i, least[find(s)]) for s, ids in sets.items() for i in ids)


def test_lists_of_many_blocks_and_texts_too_many_to_tell(spark, monkeypatch):
    """Blocks that travel in groups, and sets asked for that are shuffled, give the same links."""
    from millrace.operators import set_links
    from millrace.operators.curation import minhash_dedup

    rows = _linked_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block, group, asked in ((1024, 8, 1_000_000), (4, 3, 0), (7, 1, 0)):
        for name, value in (("BLOCK", block), ("GROUP", group), ("ASKED", asked)):
            monkeypatch.setattr(set_links, name, value)
        assert sorted((r.doc_id, r.root) for r in minhash_dedup(docs).collect()) == _roots(rows)


def test_links_keep_no_shuffle_and_move_no_text(spark, monkeypatch):
    """The driver need not collect garbage for the shuffle files to go; texts meet the ids asked for
    where they are read, also if these are too many for Spark's own broadcast."""
    from pathlib import Path

    from millrace.operators.curation import minhash_dedup
    from millrace.plans.scratch import Scratch

    plans, save = {}, Scratch.save

    def noted(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return save(self, df, name)

    def shuffled():
        tops = [Path(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
        return sum(p.stat().st_size for top in tops for p in top.rglob("shuffle_*.data"))

    monkeypatch.setattr(Scratch, "save", noted)
    words = lambda name, n: " ".join(f"{name}x{j}" for j in range(n))
    docs = spark.createDataFrame([(i, words(f"t{i // 2}", 60) + f" tail{i % 2}") for i in range(4000)], "doc_id long, text string")
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark._jvm.System.gc()
    try:
        before = shuffled()
        found = minhash_dedup(docs)
        left = shuffled() - before
        assert found.where("kept").count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert left < 400_000  # the signatures alone are 1.9 MB, moved three times
    assert "BroadcastHashJoin" in plans["first-sets"] and "SortMergeJoin" not in plans["first-sets"]


def test_agreement_makes_no_pairs(spark):
    """40,000 signatures that share a band, as texts with a common passage do, and no more."""
    sigs = spark.range(40_000).selectExpr("id as doc_id", "7L as h0", "7L as h1", *[f"id * 8 + {i} as h{i}" for i in range(2, 8)])
    near = spark.createDataFrame([(-1, 7, 7, 2, 3, 4, 5, 900, 901), (50_000, 1, 2, 3, 4, 5, 6, 7, 8), (50_001, 1, 2, 9, 4, 5, 9, 7, 8)], sigs.schema)
    whole = sigs.union(near)
    assert sorted(r.id for r in R.agreement_duplicates(whole, 8, 4, 0.75).collect()) == [0, 50_001]
    plan = R.agreement_duplicates(whole, 8, 4, 0.75)._jdf.queryExecution().executedPlan().toString()
    assert "v0" in plan and plan.count("Join") == 1  # no join of a band with itself


def test_signatures_of_texts_are_those_of_shingles(spark):
    from millrace.operators import curation as C

    texts = ["one two three four five six", "One, TWO; trois", "", None, "...", "a", "\u00c9l\u00e1n \u65e5\u672c vital a b c d e f", "x " * 9000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, C.minhash_signatures(C.shingles(d, 5), 8).collect()))
    assert sorted(map(tuple, C.text_signatures(d, 5, 8).collect())) == want and len(want) == 5


def test_a_shard_of_words_takes_few_bytes_a_place(spark):
    """Peak memory of the words, their places and 300 merges with some undone; numbers as texts have them."""
    import random
    import tracemalloc

    import numpy as np

    from millrace.operators import bpe

    rng = random.Random(1)
    words = {f" {rng.randrange(10**9)}x{rng.choice('abcdef') * rng.randrange(1, 5)}": rng.randrange(1, 9) for _ in range(60_000)}
    texts = [w.encode() for w in words]
    raw, lens = np.frombuffer(b"".join(texts), np.uint8), np.array(list(map(len, texts)))
    counts = np.array(list(words.values()))
    tracemalloc.start()
    symbols = bpe._Symbols()
    shard, totals, got = bpe._Shard(symbols, raw, lens, counts, 1000), bpe._Totals(symbols), []
    totals.add(*shard.first)
    for _ in range(300):
        key, *others = totals.leading(3)
        got.append(symbols.pair(key))
        change, _ = shard.merge(key)
        shard.undo([shard.merge(k)[1] for k in others])
        totals.add(*change)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == bpe.learn_merges(words, 300)
    assert peak < 60 * len(raw)
