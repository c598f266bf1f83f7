import gzip
import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import graders as G
from millrace.functions import text as T
from millrace.operators import analytics as A
from millrace.operators import bpe
from millrace.operators import curation as C
from millrace.operators import sequences as Q
from millrace.operators import service as S
from millrace.operators.components import connected_components
from millrace.plans.scratch import Scratch
from millrace.sources import web


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize(
    "text, masked, counts",
    [
        ("write to a.b@c.example.org now", "write to |||EMAIL_ADDRESS||| now", (1, 0, 0)),
        ("|||EMAIL_ADDRESS||| and x@y.zz", "|||EMAIL_ADDRESS||| and |||EMAIL_ADDRESS|||", (1, 0, 0)),
        ("2831823829 (283)-182-3829 (283) 182 3829 283-182-3829", " ".join(["|||PHONE_NUMBER|||"] * 4), (0, 4, 0)),
        ("at 192.0.2.1, not 999.1.2.3 or 1.2.3.256", "at |||IP_ADDRESS|||, not 999.1.2.3 or 1.2.3.256", (0, 0, 1)),
        ("", "", (0, 0, 0)),
    ],
)
def test_masks(spark, text, masked, counts):
    r = T.with_masks(docs(spark, [text])).first()
    assert (r.masked, (r.n_emails, r.n_phones, r.n_ips)) == (masked, counts)


@pytest.mark.parametrize(
    "text, ok",
    [("word " * 49, False), ("word " * 50, True), ("ab " * 60, False), ("abcdefghijk " * 60, False), ("abc " * 60, True), ("abcdefghij " * 60, True),
     ("\n".join(["the words go on..."] * 20), False), ("\n".join(["the words go on..."] * 6 + ["the words go on."] * 14), True),
     ("word " * 80 + "12345 " * 20, True), ("word " * 79 + "12345 " * 21, False)],
)
def test_gopher_limits(spark, text, ok):
    assert docs(spark, [text]).select(T.gopher_pass(T.gopher_features(F.col("text"))).alias("ok")).first().ok is ok


def test_safety_and_language(spark):
    d = docs(spark, ["you idiot, you m*oron", "one idiot", "", "日本語の本 x", "123"])
    got = d.select("doc_id", T.safety_labels(F.col("text")).alias("s"), T.letter_language(F.col("text")).alias("l")).orderBy("doc_id").collect()
    assert [r.s.toxic for r in got] == [True, False, False, False, False]
    assert [r.l.label for r in got][:3] == ["en", "en", "其他"] and got[3].l.label == "zh" and (got[4].l.label, got[4].l.score) == ("其他", 0)


def test_exact_lines(spark):
    d = docs(spark, ["a\nb\nonly", "a\nb", "c\nc\nmine\n", ""])
    got = {r.doc_id: r.text for r in C.exact_line_dedup(d).collect()}
    assert got == {0: "only", 1: "", 2: "mine\n", 3: ""}


def test_lines_keep_their_breaks(spark):
    texts = ["a\x0b\nkeep\n", "a\nother\r\n", "x\r\r\ny\x85\u2028z\x1c", "x\ry\x0c", None, "q\r\n", "q"]
    d = docs(spark, texts)
    seen = Counter(x.rstrip("\r\n") for t in texts if t for x in t.splitlines(keepends=True))
    want = {i: "".join(x for x in (t or "").splitlines(keepends=True) if seen[x.rstrip("\r\n")] == 1) for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in C.exact_line_dedup(d).collect()} == want and want[0] == texts[0]


def test_shingles_are_folded(spark):
    import unicodedata

    def fold(t):
        bare = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn")
        return "".join(" " if unicodedata.category(c)[0] == "P" else c for c in bare).split()

    texts = ["Élan—vital, «naïve» COÖPÉRATION a+b", "elan vital naive cooperation a+b", "e\u0301lan vital Na\u00efve coo\u0308peration A+B!", "\u1e9b\u0323 \u212b \u1fb4 x\x1fy\u3000z \u0130", "日本、語 ﾊﾞ"]
    d = docs(spark, texts)
    got = [r.w for r in d.select("doc_id", T.folded_words(F.col("text")).alias("w")).orderBy("doc_id").collect()]
    assert got == [fold(t) for t in texts]
    roots = {r.doc_id: r.root for r in C.minhash_dedup(d).collect()}
    assert roots[0] == roots[1] == roots[2] == 0 and roots[3] == 3


def test_minhash_dedup(spark):
    base = " ".join(f"w{i}" for i in range(200))
    d = docs(spark, [base, base + " tail", "something else altogether that is new here", base, "", ""])
    got = {r.doc_id: r.root for r in C.minhash_dedup(d).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4, 5: 4}


def test_minhash_links_away_from_the_least_id(spark):
    # each own tail is 12 % of a text: passage sharers are at similarity 0.786, a text and its copy at 0.99
    passage = [f"p{i}" for i in range(180)]
    own = lambda i, n: [f"t{i}x{j}" for j in range(n)]
    texts = [" ".join(passage + own(i, 24)) for i in range(60)]
    d = docs(spark, texts + [x + " one more" for x in texts])
    got = {r.doc_id: r.root for r in C.minhash_dedup(d).collect()}
    assert got == {i: i % 60 for i in range(120)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=14))
def test_components(spark, pairs):
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for a, b in pairs for x in (a, b) if a != b}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want


def test_dispatch_order(spark):
    rows = [(i, u, s) for i, (u, s) in enumerate([("a", "running"), ("a", "queued"), ("b", "queued"), ("b", "queued"), ("a", "queued")])]
    x = spark.createDataFrame(rows, "id long, user string, status string").withColumn("queued_at", F.col("id"))
    got = [(r.id, r.running) for r in S.fair_dispatch(x, 4).orderBy("position").collect()]
    assert got == [(2, 1), (1, 1), (3, 1)]
    none = S.fair_dispatch(x, 1).collect()
    assert [(r.running, r.id) for r in none] == [(1, None)]


def test_group_advantages(spark):
    r = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.0), (2, 1, 0.0), (3, 1, 1.0), (4, 2, 1.0)], "id long, grp long, reward double")
    got = {x.id: x.advantage for x in A.group_advantages(r).collect()}
    assert math.isclose(got[0], 0.5 / (math.sqrt(0.5) + 1e-6)) and got[4] == 0


def test_power_law(spark):
    p = spark.range(1, 21).select(F.col("id").cast("double").alias("x"), (3.5 * F.pow("id", F.lit(0.42))).alias("y"))
    r = A.power_law(p, "x", "y").first()
    assert math.isclose(r.coefficient, 3.5, rel_tol=1e-9) and math.isclose(r.exponent, 0.42, rel_tol=1e-9)


def test_windows_and_masks(spark):
    t = spark.range(10).select(F.col("id").alias("pos"), F.col("id").cast("int").alias("token"))
    got = {r.window: (r.input_ids, r.labels) for r in Q.fixed_windows(t, 4).collect()}
    assert got == {0: ([0, 1, 2, 3], [1, 2, 3, 4]), 1: ([4, 5, 6, 7], [5, 6, 7, 8])}
    m = spark.range(1).select(Q.response_mask(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)), F.lit(5), 0).alias("m")).first().m
    assert (m.input_ids, m.labels, m.mask) == ([1, 2, 3, 0], [2, 3, 0, 0], [False, True, False, False])


def test_bpe(spark):
    d = docs(spark, ["low low low low low lower lower widest widest widest newest newest newest newest newest newest"])
    vocab, merges = bpe.train_bpe(d, 256 + 6)
    assert merges[:2] == [(b"s", b"t"), (b"e", b"st")]
    ids = bpe.encode(d, vocab, merges).first().ids
    assert bpe.decode(ids, vocab) == d.first().text
    assert bpe._merge((b"a", b"a", b"a"), (b"a", b"a")) == (b"aa", b"a")


def test_bpe_tasks_together_equal_one_loop(spark, sf_dir):
    """Barrier stages against the single loop: real texts, ties, runs of a byte, other scripts, several stages."""
    small = docs(spark, ["aaaa aaa aa abab baba aabb bbaa cccccc", "xyz xyz yzx zxy xyzxyz", "\u00e9t\u00e9 \u00e9t\u00e9 \u65e5\u672c\u8a9e", "", None])
    for d, n in ((small, 60), (spark.read.parquet(f"{sf_dir}/documents.parquet"), 1500), (small.limit(0), 40)):
        counted = bpe.pretoken_counts(d).toPandas()
        want = bpe.learn_merges(dict(zip(counted["pretoken"], counted["n"])), n)
        assert bpe.train_bpe(d, 256 + n)[1] == want
    df = spark.createDataFrame(counted_words := [("abc", 5), ("bcab", 4), ("abbc", 4), ("aab", 3), ("cabc", 3), ("a", 9)], "pretoken string, n long")
    for tasks, at_once in ((1, 1), (3, 2), (8, 100)):
        assert bpe.learn_merges_distributed(df, 20, tasks, at_once) == bpe.learn_merges(dict(counted_words), 20)


def test_bpe_tasks_on_random_words(monkeypatch):
    """The tasks' loop alone, in threads that exchange as a barrier stage does, over many small random tables."""
    import random
    import threading

    import pyarrow as pa

    class Context:
        def __init__(self, i, barrier, told):
            self.i, self.barrier, self.told = i, barrier, told

        def partitionId(self):
            return self.i

        def getTaskInfos(self):
            return [type("Info", (), {"address": "127.0.0.1:0"})] * 3

        def allGather(self, message):
            self.told[self.i] = message
            self.barrier.wait(10)
            got = list(self.told)
            self.barrier.wait(10)
            return got

    here = threading.local()
    monkeypatch.setattr(bpe, "BarrierTaskContext", type("Fake", (), {"get": staticmethod(lambda: here.ctx)}))
    rng = random.Random(7)
    for _ in range(300):
        words = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        shares = [list(words.items())[i::3] for i in range(3)]
        barrier, told, out, half = threading.Barrier(3), [""] * 3, [], rng.randint(0, 20)
        known = bpe.learn_merges(words, half)

        def task(i):
            here.ctx = Context(i, barrier, told)
            own = pa.record_batch([pa.array([w for w, _ in shares[i]], pa.string()), pa.array([n for _, n in shares[i]], pa.int64())], ["pretoken", "n"])
            for b in bpe._learn(known, 40 - half)(iter([own])):
                out.extend(zip(b.column("a").to_pylist(), b.column("b").to_pylist()))

        threads = [threading.Thread(target=task, args=(i,)) for i in range(3)]
        [t.start() for t in threads]
        [t.join(20) for t in threads]
        assert known + out == bpe.learn_merges(words, 40)


def test_common_prefixes():
    assert G.common_prefix_repetition("aaaa") > 0.2 > G.common_prefix_repetition("abcd")


def test_parsers(spark):
    d = docs(spark, ["it is 72,000.5 dollars", "none", "The correct answer is B.", "C."])
    got = d.orderBy("doc_id").select(T.parse_gsm8k(F.col("text")).alias("n"), T.parse_mmlu(F.col("text")).alias("m")).collect()
    assert [(r.n, r.m) for r in got] == [("72000.5", None), (None, None), (None, "B"), (None, "C")]


def test_html_and_wet(spark, tmp_path):
    assert web.extract_text("<head><title>t</title></head><p>One  two</p><ul><li>a<li>b</ul><script>x</script>") == "One two\n\n• a\n\n• b"
    assert web.extract_text(b"caf\xe9") == "café" and web.extract_text(None) is None
    body = "naïve".encode()
    rec = lambda kind, b: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://h/\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n"
    (tmp_path / "x.wet.gz").write_bytes(gzip.compress(rec("warcinfo", b"i") + rec("conversion", body)))
    assert [(r.url, r.text) for r in web.read_wet(spark, str(tmp_path)).collect()] == [("http://h/", "naïve")]
    (tmp_path / "d.txt").write_text("one<|endoftext|>two\nlines<|endoftext|>")
    assert sorted(r.text for r in web.read_delimited(spark, str(tmp_path / "d.txt")).collect()) == ["one", "two\nlines"]
    ids = spark.createDataFrame([([1, 65535],)], "ids array<int>").select(web.uint16_tokens(web.uint16_bytes("ids")).alias("x")).first().x
    assert ids == [1, 65535]
