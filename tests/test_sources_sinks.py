"""File sources, sinks, archives, models and lifecycles."""

import gzip
import json
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.functions import answers as W
from millrace.functions import text as T
from millrace.functions.graders import is_repetitive
from millrace.operators import bpe
from millrace.operators import reports as R
from millrace.plans.scratch import Scratch
from millrace.sources import files, sinks, web
from millrace.streaming import lifecycle as L


def put(tmp_path, name, data):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return f"file://{path}"


def record(kind, payload, **heads):
    lines = [f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(payload)}\r\n", *(f"{k.replace('_', '-')}: {v}\r\n" for k, v in heads.items()), "\r\n"]
    return "".join(lines).encode() + payload + b"\r\n\r\n"


def test_texts(spark, tmp_path):
    put(tmp_path, "in/a.txt", "x\r\ny\rz")
    put(tmp_path, "in/b.txt.gz", gzip.compress(b"packed"))
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in files.read_whole_texts(spark, f"file://{tmp_path}/in").collect()}
    assert got == {"a.txt": "x\ny\nz", "b.txt.gz": "packed"}


def test_json_and_csv(spark, tmp_path):
    lines = put(tmp_path, "x.jsonl", '{"a": 1}\n\n{"a": 2}\n')
    array = put(tmp_path, "x.json", '[{"a": 3},\n {"a": 4}]')
    assert sorted(r.a for r in files.read_json(spark, lines, "a int").collect()) == [1, 2]
    assert sorted(r.a for r in files.read_json(spark, array, "a int", array=True).collect()) == [3, 4]
    assert files.read_csv(spark, put(tmp_path, "n.csv", "a,b\n1,x\n"), "a int, b string").collect() == [(1, "x")]
    good = put(tmp_path, "users.csv", "user_id,api_key\n ann , k1\nbob,k2 \n")
    assert sorted(map(tuple, files.read_strict_csv(spark, good, ["user_id", "api_key"]).collect())) == [("ann", "k1"), ("bob", "k2")]
    with pytest.raises(ValueError):
        files.read_strict_csv(spark, put(tmp_path, "bad.csv", "api_key,user_id\na,b\n"), ["user_id", "api_key"])
    listed = put(tmp_path, "paths.gz", gzip.compress("\n".join(f"p/{i}.wet.gz" for i in range(50)).encode()))
    one, two = ([r.path for r in files.read_path_list(spark, listed, 5, seed).collect()] for seed in (1, 2))
    assert len(set(one)) == 5 and one != two and one == [r.path for r in files.read_path_list(spark, listed, 5, 1).collect()]


def test_archives(spark, tmp_path):
    texts = ["good words", "schlecht", "broken \udcff".encode("utf-8", "surrogateescape")]
    rows = [record("warcinfo", b"about"), *(record("conversion", t if isinstance(t, bytes) else t.encode(), WARC_Target_URI=f"http://x/{i}") for i, t in enumerate(texts))]
    put(tmp_path, "in/one.warc.wet.gz", b"".join(map(gzip.compress, rows)))
    put(tmp_path, "in/empty.warc.wet.gz", gzip.compress(b""))
    folder = f"file://{tmp_path}/in"
    got = sorted((r.url, r.text) for r in web.read_wet(spark, folder).collect())
    assert got == [("http://x/0", "good words"), ("http://x/1", "schlecht"), ("http://x/2", "broken �")]
    made = sinks.rewrite_archives(spark, folder, f"file://{tmp_path}/out", lambda t: "good" in t).collect()
    assert sorted(map(tuple, made)) == [("empty.warc.wet.gz", 0, 0), ("one.warc.wet.gz", 4, 2)]
    kept = gzip.decompress((tmp_path / "out/one.warc.wet.gz").read_bytes())
    assert kept == rows[0] + rows[1]
    from millrace.streaming.events import drain

    streamed = drain(web.stream_wet(spark, folder), f"file://{tmp_path}/rows", f"file://{tmp_path}/cp")
    assert sorted((r.url, r.text) for r in streamed.collect()) == got


def test_pages_with_an_open_head():
    assert web.extract_text("<html><head><title>t</title><body><p>visible words</p>") == "visible words"
    assert web.extract_text("<head><style>p{}</style></head><body>a<ul><li>b</ul>") == "a\n\n• b"
    assert web.extract_text("<head><title>t</title><div>x</div>") == "x"
    assert web.extract_text("<p>a</p></head><p>b</p><script>no</script>") == "a\n\nb"


def test_safety_folds_before_it_looks(spark):
    texts = ["you aßhole, aßhole", "an aſſhole and ASSHOLE", "bastard", "f*ck and porn", "ﬁne words", "a bitch and a TWAT"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.s.nsfw, r.s.toxic) for r in d.select("i", T.safety_labels(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(6)] == [(False, True), (False, True), (False, False), (True, False), (False, False), (False, True)]


def test_models(spark, tmp_path):
    def load(path):
        words = json.load(open(path))
        return lambda text: ("__label__EN", 0.9) if "\n" not in text and any(w in words for w in text.split()) else None

    model = str(tmp_path / "m.json")
    json.dump(["the"], open(model, "w"))
    d = spark.createDataFrame([(0, "see the\nsea"), (1, "nix"), (2, " \n"), (3, None)], "i int, t string")
    fallback = F.struct(F.lit("none").alias("label"), F.lit(0.0).alias("score"))
    run = lambda paths: {r.i: (r.p.label, r.p.score) for r in d.select("i", files.predicted(load, paths, F.col("t"), fallback).alias("p")).collect()}
    assert run(("/nowhere", model)) == {0: ("__label__EN", 0.9), 1: ("none", 0.0), 2: ("none", 0.0), 3: ("none", 0.0)}
    assert set(run(("/nowhere",)).values()) == {("none", 0.0)}
    assert [r.x for r in spark.createDataFrame([("__label__Hate_Speech",), ("neutral",)], "l string").select(files.safety_outcome("toxic", F.col("l")).alias("x")).collect()] == ["toxic", "non-toxic"]


def test_artifacts_are_made_once(spark):
    calls = []

    def create():
        calls.append(1)
        return spark.range(3)

    params = {"b": 1, "a": [uuid.uuid4().hex]}  # the folder outlives a session
    assert files.load_or_create(spark, "t", params, create).count() == files.load_or_create(spark, "t", dict(reversed(params.items())), create).count() == 3
    assert len(calls) == 1


def test_survivors_shards_and_logs(spark):
    scratch = Scratch(spark, "sinks")
    d = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "i long, t string")
    sinks.write_survivors(d, d.where("i > 3"), ["i"], scratch.path("kept"))
    assert sorted(r.i for r in spark.read.parquet(scratch.path("kept")).collect()) == [0, 1, 2, 3]
    sinks.write_token_shards(d.selectExpr("'train' as split", "i % 2 as shard", "i"), scratch.path("shards"))
    back = spark.read.option("basePath", scratch.path("shards")).parquet(scratch.path("shards/split=train/shard=000001"))
    assert sorted(r.i for r in back.collect()) == [1, 3, 5]
    sinks.write_summary(spark.createDataFrame([(1, None)], "n int, x string"), scratch.path("summary"))
    assert [json.loads(r.value) for r in spark.read.text(scratch.path("summary")).collect()] == [{"n": 1, "x": None}]
    sinks.append_jsonl(spark.createDataFrame([(1, 0.5), (2, 0.3)], "step int, loss double"), scratch.path("log"))
    sinks.append_jsonl(spark.createDataFrame([(3, 0.3)], "step int, loss double"), scratch.path("log"))
    row = sinks.best_so_far(spark, scratch.path("log"), "step int, loss double", "loss").first()
    assert (row.last_step, row.best.step) == (3, 2)
    with pytest.raises(Exception, match="16 bits"):
        sinks.write_token_files(spark.createDataFrame([([70000], "x")], "ids array<int>, text string"), scratch.path("bad"), 0).collect()


def test_tokenizer_artifacts_and_specials(spark):
    docs = spark.createDataFrame([(1, "low lower lowest<|end|>low"), (2, None), (3, "<|end|><|end|>more")], "i int, text string")
    specials = ("<|end|>", "<|end|><|end|>", "<|end|>")
    vocab, merges = bpe.train_bpe(docs, 256 + 8 + 2, specials)
    folder = Scratch(spark, "tokenizer").path("t")
    sinks.save_tokenizer(spark, vocab, merges, folder)
    assert sinks.load_tokenizer(spark, folder) == (vocab, merges)
    ids = {v: k for k, v in vocab.items()}
    got = {r.i: list(r.ids) for r in bpe.encode(docs, vocab, merges, specials=specials).collect()}
    assert got[1].count(ids[b"<|end|>"]) == 1 and got[3][0] == ids[b"<|end|><|end|>"] and got[2] == []
    assert {i: bpe.decode(x, vocab) for i, x in got.items()} == {1: "low lower lowest<|end|>low", 2: "", 3: "<|end|><|end|>more"}
    assert len(set(sinks.byte_letters().values())) == 256


def test_answers():
    same = [("\\frac{1}{2}", "0.5"), ("\\dfrac12", "1/2"), ("x=5", "5"), ("\\sqrt3", "\\sqrt{3}"), ("10\\%", "10"), ("1,234", "1234"), ("(1, 2)", "(1,2)"),
            ("7 3/4", "7+3/4"), ("5 \\text{ cm}", "5"), ("\\text{yes}", "Yes"), ("3.0", "3"), ("2+1/2", "5/2+0"), ("\\left(1,\\frac{2}{3}\\right]", "(1,2/3]"), ("90^{\\circ}", "90"),
            ("\\$1,234.50", "1234.5"), ("7\\frac34", "7 3/4"), ("12 cm^2", "12"), ("1 or 2", "1,2"), ("\\frac{x+1}{2}", "(x+1)/2"), ("2\\pi", "2 \\pi"), ("0.25", "1/4"),
            ("5 miles per hour", "5"), ("4", "so \\boxed{4}"), ("\\sqrt[3]{2}", "\\sqrt[3]2"), (".5", "0.5"), ("-\\tfrac{1}{2}", "-0.5")]
    other = [("2/4", "1/2"), ("[1,2)", "(1,2)"), ("(1,2,3)", "(1,2)"), ("4.2", "4"), ("", "4"), ("x", "y"), (None, "1"), ("1/0", "2/0"), ("4/2", "2"), ("3.14159", "3.1416"),
             ("2*5", "10"), ("(2,1)", "(1,2)"), ("a", "b"), ("4", None), ("\\sqrt2", "\\sqrt3")]
    assert [x for x in same if not W.grade(*x)] == [] and [x for x in other if W.grade(*x)] == []
    assert W.final_spelling("an answer of \\$100,000 dollars") == "answerof100,000" and W.final_spelling("$100,000$") == "100000" and W.final_spelling("\\frac12") == "\\frac{1}{2}"
    assert W.spelling("5 million") == "5*10^6" and W.spelling("12 cm^2") == "12" and W.spelling("3.0") == "3" and W.spelling("{") == "" and W.spelling("\\frac") == "()/()"
    assert W.boxed_reward("so \\boxed{4}", ["3", "4"]) == (1.0, 1.0, 1.0) and W.boxed_reward("4", "4") == (0.0, 0.0, 0.0) and W.boxed_reward("\\boxed{5}", "4") == (0.0, 1.0, 0.0)
    assert W.format_reward("x</think> <answer>\\boxed{4}</answer>", "4") == (1.0, 1.0, 1.0) and W.format_reward("4", "4") == (0.0, 0.0, 0.0)
    assert W.format_reward("x</think> <answer>2/4</answer>", "1/2") == (0.0, 1.0, 0.0) and W.format_reward("</think> <answer>\\boxed{4</answer>", "4") == (0.0, 1.0, 0.0)
    assert W.last_boxed("so \\boxed{a{b}c}") == "a{b}c" and W.last_boxed("\\boxed{a") is None and W.last_boxed("\\boxed{1} \\fbox{2}") == "2"
    assert W.value_of("2*(3+4)^2/7") == 14 and W.value_of("1/0") is None and W.value_of("9^99") is None


def test_repetitive(spark):
    d = spark.createDataFrame([("aaaaaaaaaa",), ("abcdefghij",), ("",), (None,)], "t string")
    assert [r.x for r in d.select(is_repetitive("t").alias("x")).collect()] == [True, False, False, None]


def test_agreement_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    base = [[rng.randrange(5) for _ in range(8)] for _ in range(12)]
    rows = [(i, *[v if rng.random() < 0.8 else rng.randrange(5) for v in rng.choice(base)]) for i in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"h{i} int" for i in range(8)))
    got = {r.id for r in R.agreement_duplicates(d, 8, 4, 0.75).collect()}
    band = lambda x, y: any(x[1 + 2 * b : 3 + 2 * b] == y[1 + 2 * b : 3 + 2 * b] for b in range(4))
    want = {y[0] for x in rows for y in rows if x[0] < y[0] and band(x, y) and sum(a == b for a, b in zip(x[1:], y[1:])) >= 6}
    assert got == want and want


def test_dispatch_and_metrics(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/ticks/a")
    ticks = spark.readStream.schema("id long").parquet(f"file://{tmp_path}/ticks/*")
    ledger, ran = f"file://{tmp_path}/ledger", []

    def start(row, key):
        if row["id"] == 2:
            raise RuntimeError("no slot")
        ran.append((row["id"], row["gpu"], key))

    # what a driver leaves that is lost between a choice and its second start
    claimed = spark.range(4).selectExpr("id", "'a' AS gpu", "concat('start-', id) AS key")
    claimed.write.parquet(f"{ledger}/claims/tick=0")
    spark.createDataFrame([(0, "start-0", "started", None)], L.LEDGER).write.parquet(f"{ledger}/outcomes/id=0-")
    L.dispatch(ticks, lambda s, known: s.range(4, 9).withColumn("gpu", F.lit("b")), start, ledger, f"file://{tmp_path}/cp").awaitTermination()
    assert ran == [(1, "a", "start-1"), (3, "a", "start-3")]  # the claims of the lost tick, none twice, none new
    spark.range(1).write.parquet(f"file://{tmp_path}/ticks/b")
    L.dispatch(ticks, lambda s, known: s.range(2, 6).withColumn("gpu", F.lit("b")), start, ledger, f"file://{tmp_path}/cp").awaitTermination()
    assert [x[0] for x in ran] == [1, 3, 4, 5]
    told = {r.id: (r.outcome, r.error) for r in L.read_ledger(spark, ledger).collect()}
    assert told[2][0] == "failed" and "no slot" in told[2][1] and [k for k in told if told[k][0] == "started"] and len(told) == 6
    for _ in range(2):  # the second run has nothing new to say
        L.log_metrics(ticks.selectExpr("id as step", "id * 0.5 as loss"), f"file://{tmp_path}/log", f"file://{tmp_path}/cp2").awaitTermination()
    assert sorted(r.step for r in spark.read.schema("step long, loss double").json(f"file://{tmp_path}/log").collect()) == [0, 0, 1, 2]
    assert "created_at" in L.arrived(ticks).columns


def test_zip_needs_equal_lengths(spark):
    d = spark.createDataFrame([(["a", "b"], ["c"])], "l array<string>, r array<string>")
    with pytest.raises(Exception, match="differ in length"):
        d.select(R.zipped(F.col("l"), F.col("r"))).collect()


def test_reads_beyond_the_data(spark):
    from millrace.operators.sampling import permuted_reads, window_starts

    chunks = spark.range(2).withColumnRenamed("id", "chunk")
    assert sorted((r.chunk, r.sequence) for r in permuted_reads(chunks, 4, 0, 8).collect()) == [(c, s) for c in range(2) for s in range(4)]
    with pytest.raises(ValueError):
        permuted_reads(chunks, 4, 1, 8)
    with pytest.raises(ValueError):
        window_starts(5, 5, chunks)


def test_equal_names_are_not_overwritten(spark, tmp_path):
    d = spark.createDataFrame([("a/x.txt", "1"), ("b/x.txt", "2")], "path string, text string")
    with pytest.raises(ValueError, match="2 rows are to be written to x.txt"):
        sinks.write_texts(d, f"file://{tmp_path}/o", "path")


def test_quality_sides(spark):
    d = spark.createDataFrame([("__label__Wiki",), ("HIGH_quality",), ("low",), ("cc",), (None,)], "l string")
    assert [r.s for r in d.select(files.quality_side(F.col("l")).alias("s")).collect()] == ["wiki", "wiki", "cc", "cc", None]
    with pytest.raises(Exception, match="unknown quality label: other"):
        spark.createDataFrame([("other",)], "l string").select(files.quality_side(F.col("l"))).collect()


def test_permutation_in_few_and_many_parts(spark):
    from millrace.operators.sampling import permuted

    d = spark.range(500)
    few, many = ({r.id: r.position for r in permuted(d, "id", 3, n).collect()} for n in (1000, 7))
    assert few == many and sorted(few.values()) == list(range(500)) and permuted(d.limit(0), "id").count() == 0
