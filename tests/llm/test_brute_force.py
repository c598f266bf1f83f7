"""Operators that SQL cannot express against plain versions of the same method."""

import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import exact_search
from millrace.llm.exact_search import exact_top_k
from millrace.llm.language_id import DIMENSION, _symbol_vectors, fit_profiles, predict_languages
from millrace.llm.near_dup import drop_near_duplicates, match_thresholds, near_duplicates, spanning_links
from millrace.llm.packing import best_fit, pack_documents
from millrace.llm.quality_rules import CONSISTENCY, FLOORS, SUPPORT, quality_verdicts
from millrace.llm.secret_scan import redact_secrets, scan_secrets
from millrace.llm.sharding import kd_shards
from millrace.llm.token_counts import count_tokens
from millrace.llm.warc_zst import parse_record, record_bytes
from millrace.plans.scratch import Scratch


# --- op1 -----------------------------------------------------------------------------------------


def kd_tree(rows, dims, shards, width):
    """Shard of each row ``(weight, tie, values)`` by recursive weighted medians."""
    if shards == 1 or not rows:
        return {r[0]: 0 for r in rows}
    span = [max(r[3][d] for r in rows) - min(r[3][d] for r in rows) for d in range(dims)]
    d = max(range(dims), key=lambda x: span[x] / width[x])
    low = min(r[3][d] for r in rows)
    scale = ((1 << 30) - 1) / span[d] if span[d] else 0.0
    key = {r[0]: (math.floor((r[3][d] - low) * scale) << 32) + r[2] for r in rows}
    rows = sorted(rows, key=lambda r: key[r[0]])
    want, before, cut = sum(r[1] for r in rows) * (shards // 2) / shards, 0, 0
    while before + rows[cut][1] < want:
        before, cut = before + rows[cut][1], cut + 1
    cut += before + rows[cut][1] - want <= want - before
    left, right = kd_tree(rows[:cut], dims, shards // 2, width), kd_tree(rows[cut:], dims, shards - shards // 2, width)
    return left | {k: v + shards // 2 for k, v in right.items()}


def test_kd_tree(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 90), rng.randrange(1 << 32), (rng.random(), float(rng.randint(0, 5)), rng.gauss(0, 3))) for i in range(700)]
    units = spark.createDataFrame([(i, w, t, *v) for i, w, t, v in rows], "i long, weight long, tie long, d0 double, d1 double, d2 double")
    got = {r.i: r.shard for r in kd_shards(units, ["d0", "d1", "d2"], 13, Scratch(spark, "kd"), buckets=16).collect()}
    width = [max(r[3][d] for r in rows) - min(r[3][d] for r in rows) for d in range(3)]
    assert got == kd_tree(rows, 3, 13, width)


# --- op2 -----------------------------------------------------------------------------------------


def plain_best_fit(items, capacity):
    bins, out = [], {}
    for at in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        size, source, cluster = items[at]
        fits = [b for b in bins if b["left"] >= size and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        if not fits:
            bins.append({"left": capacity, "s": set(), "c": set(), "n": len(bins)})
            fits = [bins[-1]]
        best = min(fits, key=lambda b: (b["left"], b["n"]))
        out[at] = (best["n"], capacity - best["left"])
        best["left"] -= size
        best["s"].add(source)
        best["c"].add(cluster)
    return [out[i] for i in range(len(items))]


def test_best_fit_is_the_tightest():
    rng = random.Random(2)
    for _ in range(60):
        items = [(rng.randint(1, 40), rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, 1, 2, 3])) for _ in range(rng.randint(0, 80))]
        assert best_fit(items, 50) == plain_best_fit(items, 50)


def test_no_two_open_bins_fit(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("aé語😀") for _ in range(rng.randint(0, 400))), rng.choice([None, "s", "t", "u", "v"])) for i in range(300)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=512).toPandas()
    text, source = {r[0]: r[1].encode() for r in rows}, {r[0]: r[2] for r in rows}
    for doc, own in got.sort_values("piece").groupby("doc_id"):
        pieces = [text[doc][s : s + n] for s, n in zip(own["start"], own["size"])]
        assert b"".join(pieces) == text[doc] and all(p.decode() is not None for p in pieces)
    bins = [(own["size"].sum(), {source[d] for d in own["doc_id"]} - {None}, {text[d] for d in own["doc_id"]} - {b""}) for _, own in got.groupby("bin_id")]
    assert max(b[0] for b in bins) <= 512
    assert not any(x[0] + y[0] <= 512 and not x[1] & y[1] and not x[2] & y[2] for i, x in enumerate(bins) for y in bins[:i])


# --- op3 -----------------------------------------------------------------------------------------


def plain_top(queries, rows, k):
    out = set()
    for q, v in queries:
        clip = lambda s: max(-(2**63), min(2**63 - 1, s))
        scores = sorted((-clip(sum(a * b for a, b in zip(v, w))), c) for c, w in rows if c != q)
        out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("kind", ["many", "repeated", "unequal", "empty", "overflow"])
def test_search_equals_plain_scores(spark, monkeypatch, kind):
    monkeypatch.setattr(exact_search, "BLOCK", 64)
    monkeypatch.setattr(exact_search, "QUERY_BLOCK", 8)
    rng = random.Random(4)
    vector = lambda n, top: [rng.randint(-top, top) for _ in range(n)]
    rows = {
        "many": [(i, vector(32, 60)) for i in range(600)],
        "repeated": [(0, [1, 2])] * 3 + [(i, vector(2, 5)) for i in (1, 2, 3, 3, 20, 20)],
        "unequal": [(i, vector(rng.randint(0, 40), 60)) for i in range(200)],
        "empty": [(i, []) for i in range(30)],
        "overflow": [(0, [-1, 0]), (1, [-(2**63), 0]), (2, [5, 5]), (20, [-(2**63), 2**63 - 1]), (3, [2**62, 2**62]), (4, [0, -(2**63)])],
    }[kind]
    every = 20
    queries = sorted({(i, tuple(v)) for i, v in rows if i % every == 0})
    schema = "id long, v array<long>"
    got = exact_top_k(spark.createDataFrame([r for r in rows if r[0] % every == 0], schema), spark.createDataFrame(rows, schema).repartition(3), 7).collect()
    want = plain_top(queries, rows, 7)
    assert {tuple(r) for r in got} == want and len(got) >= len(want)


# --- op5 -----------------------------------------------------------------------------------------


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(rows, k, inner, union):
    """Row numbers of each group of linked texts; rows without id or words are left out."""
    sets = {i: shingles(t, k) for i, (d, t) in enumerate(rows) if d is not None}
    sets = {i: s for i, s in sets.items() if s}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and union * len(sets[i] & sets[j]) >= inner * len(sets[i] | sets[j]):
                root[find(j)] = find(i)
    out = {}
    for i in sets:
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def near_rows():
    rng = random.Random(6)
    rows = []
    for g in range(12):
        base = [f"w{g}_{i}" for i in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 12)):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            rows.append((rng.randint(0, 30), " ".join(copy)))
    # bridges: a hub that heads all shared lists, of texts more like each other than like it
    for g in range(6):
        hub = [f"h{g}_{i}" for i in range(300)]
        near = hub[:265] + [f"y{g}_{i}" for i in range(40)]
        rows += [(100 + 3 * g, " ".join(hub)), (101 + 3 * g, " ".join(near)), (102 + 3 * g, " ".join([*near[:-4], "z z z"]))]
    return [*rows, (1, "a b c"), (1, "A  b\nc"), (2, "a b"), (3, ""), (3, None), (None, "a b c"), (4, "one two three four five six"), (4, "seven eight nine ten eleven")]


@pytest.mark.parametrize("inner", [80, 50, 95])
def test_links_equal_plain_sets(spark, inner):
    rows = near_rows()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, inner, 100).collect()
    want = []
    for own in groups(rows, 4, inner, 100):
        least = min(rows[i][0] for i in own)
        want += [(rows[i][0], len(shingles(rows[i][1], 4)), least, rows[i][0] == least) for i in own]
    want += [(d, len(shingles(t, 4)), d, True) for d, t in rows if d is None or not shingles(t, 4)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_dense_lists_of_unlinked_texts(spark):
    """Variants of one text whose similarity is around the threshold, a few of them copies."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(400), 5):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[10 * i + 9][1] + " tail") for i in range(16)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 84, 100).collect()}
    want = {}
    for own in groups(rows, 4, 84, 100):
        want |= {rows[i][0]: min(rows[j][0] for j in own) for i in own}
    assert got == want and 16 <= len(rows) - len(set(want.values()))


@pytest.mark.parametrize("inner", [80, 60])
def test_spanning_links(inner):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice([f"a{j}", f"a{j}", f"b{j}"]) for j in range(40))) for i in range(60)] + [(60, "q w e r t"), (61, "Q w e r t")]
    ids = {w: i for i, w in enumerate({s for _, t in rows for s in shingles(t, 2)})}
    sets = [np.array(sorted(ids[s] for s in shingles(t, 2)), dtype=np.uint64) for _, t in rows]
    root = {i: i for i, _ in rows}
    for a, b in spanning_links(np.arange(62), sets, inner, 100):
        assert root[a] != root[b]
        root = {i: root[a] if r == root[b] else r for i, r in root.items()}
    got = sorted(sorted(i for i in root if root[i] == r) for r in set(root.values()))
    assert got == sorted(map(sorted, groups(rows, 2, inner, 100)))


def test_one_row_of_each_group_stays(spark):
    rows = near_rows()
    got = [tuple(r) for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()]
    whole = groups(rows, 5, 80, 100)
    assert len(got) == len(whole) + sum(d is None or not shingles(t, 5) for d, t in rows)
    for own in whole:
        assert any(rows[i] in got and rows[i][0] == min(rows[j][0] for j in own) for i in own)


def test_thresholds_follow_the_similarity():
    assert match_thresholds(0.8) == (38, 379) and match_thresholds(1.0) == (64, 512)
    a, b = zip(*[match_thresholds(x / 20) for x in range(1, 21)])
    assert list(a) == sorted(a) and list(b) == sorted(b)


# --- op7 -----------------------------------------------------------------------------------------


def mcd(x):
    """Centre and covariance of least determinant over the three starts, with exact order statistics."""
    n, floor = len(x), np.array(FLOORS)
    at = lambda v, q: np.sort(v, axis=0)[max(math.ceil(q * n), 1) - 1]
    z = (x - at(x, 0.5)) / np.maximum((at(x, 0.75) - at(x, 0.25)) / 1.349, floor)
    best = None
    for d in ((z**2).sum(1), np.abs(z).max(1), np.tanh(np.abs(z)).sum(1)):
        for _ in range(4):
            core = x[d <= at(d, SUPPORT)]
            mean = core.mean(0)
            cov = CONSISTENCY * (core - mean).T @ (core - mean) / max(len(core) - 1, 1)
            full = cov.copy()
            np.fill_diagonal(full, np.maximum(np.diag(cov), floor**2))
            d = np.einsum("ij,ij->i", (x - mean) @ np.linalg.inv(full), x - mean)
        det = np.linalg.slogdet(full)[1]
        if best is None or det < best[0] - 1e-12:
            best = det, mean, cov
    return n, best[1], best[2]


def drawn(own, above, prior=50.0):
    w = own[0] / (own[0] + prior)
    return own[0], w * own[1] + (1 - w) * above[1], w * own[2] + (1 - w) * above[2]


def test_verdicts_equal_plain_estimates(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None])
        n = int(math.exp(rng.gauss(4.6, 0.7))) + 20
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(n)]
        if rng.random() < 0.12:
            words = [w if j % 2 else "|" * rng.randint(1, 3) for j, w in enumerate(words)]
        if rng.random() < 0.05:
            words = [w * 9 for w in words]
        rows.append((i, " ".join(words), lang, source))
    got = {r.doc_id: r for r in quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    fit = {i: r for i, r in got.items() if not r.base_failed}
    vec = {}
    for i, r in fit.items():
        share = (r.n_repeat_words / r.n_words + r.n_dup_lines / r.n_words) / 2
        vec[i] = [math.log(r.n_words), r.word_chars / r.n_words, math.log1p(100 * r.n_symbols / r.n_words), math.asin(math.sqrt(min(1.0, share)))]
    tags = {i: (lang, source) for i, _, lang, source in rows}
    of = lambda test: np.array([vec[i] for i in sorted(fit) if test(tags[i])])
    top = mcd(of(lambda t: True))
    dropped = 0
    for tag in set(tags.values()):
        own = drawn(mcd(of(lambda t, g=tag: t == g)), drawn(mcd(of(lambda t, g=tag: t[0] == g[0])), top))
        cov = own[2].copy()
        np.fill_diagonal(cov, np.maximum(np.diag(cov), np.array(FLOORS) ** 2))
        for i in fit:
            if tags[i] == tag:
                d = np.array(vec[i]) - own[1]
                want = d @ np.linalg.inv(cov) @ d
                assert fit[i].distance == pytest.approx(want, rel=1e-6, abs=1e-9)
                assert fit[i].kept == (want <= 33.4)
                dropped += not fit[i].kept
    assert 20 < dropped < 300 and not any(r.kept for r in got.values() if r.base_failed)


# --- op8 -----------------------------------------------------------------------------------------


def test_redaction_of_overlaps(spark):
    rng = random.Random(8)
    parts = ["password=abcdefgh", "AKIA" + "B2" * 9, "0123456789abcdef" * 2, "Abcdefghijklmnopqrstuvwxyz0123456789ABCD", "https://x.example/y?token=zzzzzzzz", " ", "\n", "é", "secret: deadbeef" * 2, "word"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 150)))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.all_spans for r in scan_secrets(d, scope_lines=20).collect()}
    for r in redact_secrets(d).collect():
        text, out, end = rows[r.doc_id][1], "", 0
        for s in spans[r.doc_id]:
            if s.s >= end:
                out += text[end : s.s] + "[SECRET]"
            end = max(end, s.e)
        assert r.text == out + text[end:]


# --- op4, op9 --------------------------------------------------------------------------------------


def test_counts_over_many_chunks(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr("millrace.llm.token_counts.HELD_COUNTS", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the", "The", "zebra\n", "é語", "1234", "<|endoftext|>", "don't"]) * rng.randint(1, 3) for _ in range(40))) for i in range(300)]
    got = {r.doc_id: r.n_tokens for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path).collect()}
    tk = Tokenizer.from_file(path)
    assert got == {i: len(tk.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_a_revisit_names_its_record():
    first = parse_record(record_bytes("response", 1, "http://a/", "d" * 64, b"", None).replace(b"WARC-Payload-Digest", b"X-Digest"))
    again = parse_record(record_bytes("revisit", 2, "http://b/", "d" * 64, b"", 1, "http://a/"))
    assert again["warc-refers-to"] == first["warc-record-id"] and again["warc-refers-to-target-uri"] == "http://a/"


# --- op10 ----------------------------------------------------------------------------------------


def plain_vector(text):
    """Sum over trigrams of the products of letters' vectors, each rotated by its place."""
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    s = re.sub(" +", " ", s)
    points = np.array([0 if c == " " else ord(c) for c in s])
    v = _symbol_vectors(points).astype(np.int64)
    return sum((np.roll(v[i], 2) * np.roll(v[i + 1], 1) * v[i + 2] for i in range(len(s) - 2)), np.zeros(DIMENSION, np.int64))


def test_predictions_equal_plain_vectors(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).collect()
    rows = [(r.doc_id, r.text[:3000], r.lang) for r in docs] + [(900, "", "en"), (901, "12 34", "de"), (902, None, "de"), (903, "ÄÖ ß", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    vec = {i: plain_vector(t or "") for i, t, _ in rows}
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    protos = {}
    for i, t, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2 and re.search(r"[^\W\d_]", t or ""):
            protos[lang] = protos.get(lang, 0) + np.rint(unit(vec[i]) * 4096)
    protos = {x: unit(v) for x, v in protos.items()}
    fitted = fit_profiles(d)
    assert sorted(fitted) == sorted(protos) and all(np.allclose(fitted[x], protos[x], atol=2e-3) for x in protos)
    for r in predict_languages(d, fitted).collect():
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cos = {x: float(unit(vec[r.doc_id]) @ p) for x, p in protos.items()}
        assert r.score == pytest.approx(max(0.0, max(cos.values())), abs=2e-3)
        assert cos[r.lang_pred] >= max(cos.values()) - 2e-3


# --- pipeline --------------------------------------------------------------------------------------


def test_stages_keep_what_plain_rules_keep(spark):
    rng = random.Random(10)
    vocabulary = {"en": "the house with many windows stands there and they would think about this long road home again tomorrow".split(),
                  "de": "das schöne haus steht dort und wir werden nicht über diese lange straße nach hause gehen morgen".split()}
    clean = [(i, " ".join(rng.choice(vocabulary[x]) + rng.choice(["", "", "s", "en"]) for _ in range(rng.randint(40, 80))), x) for i, x in ((i, "en" if i % 2 else "de") for i in range(300))]
    copies = [(1000 + i, clean[i][1] + (" extra" if i % 2 else ""), clean[i][2]) for i in range(40)]
    junk = [(2000, "αβγ δεζ ηθι κλμ νξο πρσ τυφ χψω " * 8, None), (2001, "1234 5678 " * 30, "en")]
    failing = [(3000, "the house with", "en"), (3001, "they would think about this road home " * 30, "en")]
    secret = [(4000, clean[0][1][::-1].replace("e", "o") + " password=hunter2hunter2", "en")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = lambda rows: spark.createDataFrame([(i, t, x, f"s{i % 3}", len(t)) for i, t, x in rows], schema)
    ids = lambda df: {r.doc_id for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    named = ids(stages["language_id"](spark, table([*clean, *junk]), ""))
    assert not {2000, 2001} & named and len(named) >= 0.97 * len(clean)
    judged = ids(stages["quality_rules"](spark, table([*clean, *failing]), ""))
    assert judged == {r[0] for r in clean}
    alone = ids(stages["minhash_near_dup"](spark, table([*clean, *copies]), ""))
    rows = [(r[0], r[1]) for r in (*clean, *copies)]
    assert alone == {min(rows[i][0] for i in own) for own in groups(rows, 5, 80, 100)}
    told = {r.doc_id: r for r in stages["secret_scan"](spark, table([*clean, *secret]), "").collect()}
    assert len(told) == len(clean) + 1 and told[4000].text.endswith("[SECRET]") and told[4000].n_chars == len(told[4000].text)
    assert all(told[i].text == t for i, t, _ in clean)
    packed = stages["best_fit_packing"](spark, table(clean), "").collect()
    # within one window the packing is the plain best fit's, whatever order ties go in
    want = plain_best_fit([(len(t.encode()), f"s{i % 3}", t) for i, t, _ in clean], 8192)
    assert len({r.bin_id for r in packed}) == len({b for b, _ in want}) and {r.doc_id for r in packed} == {r[0] for r in clean}
