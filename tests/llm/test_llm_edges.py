"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import exact_search, warc_zst
from millrace.llm.language_id import fit_profiles, predict_languages
from millrace.llm.near_dup import drop_near_duplicates, near_duplicates
from millrace.llm.packing import best_fit, pack_documents
from millrace.llm.quality_rules import quality_verdicts
from millrace.llm.secret_scan import redact_secrets, secret_report
from millrace.llm.sentence_pieces import decode_pieces, encode_pieces
from millrace.llm.sharding import shard_documents
from millrace.llm.token_counts import count_tokens, pack, unpack

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, sig binary, score double, node int"
LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [
    (0, LONG, "en", "a"), (1, LONG, None, None), (1, LONG, None, None), (2, "", "en", "a"), (3, None, "en", "a"), (None, "some words", "de", "b"),
    (None, None, None, None), (4, "   \n\t ", "en", "b"), (5, "12 34", "en", "b"), (6, "Ein Wort", "de", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, None, 7, 7, b"x", 0.5, 1) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_each_row_is_answered(odd, paths):
    n = len(ROWS)
    assert shard_documents(odd, 4).count() == n
    assert {r.doc_id for r in pack_documents(odd, 512).collect()} == {r[0] for r in ROWS}
    assert sorted((r.n_bytes, r.n_tokens == 0) for r in count_tokens(odd, paths[0]).collect())[:3] == [(0, True)] * 3
    got = near_duplicates(odd, 4).collect()
    assert len(got) == n and all(r.component_id == 0 for r in got if r.doc_id in (0, 1))
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None) and all(r.kept for r in got if r.doc_id in (2, 3, 4))
    judged = quality_verdicts(odd).collect()
    assert len(judged) == n and all(r.base_failed for r in judged if r.doc_id not in (0, 1))
    assert secret_report(odd).count() == n
    coded = decode_pieces(encode_pieces(odd, paths[1]), paths[1]).collect()
    assert all(r.decoded == r.text for r in coded)
    pred = predict_languages(odd, fit_profiles(odd)).collect()
    assert len(pred) == n and all(r.lang_pred == "und" and r.score == 0 for r in pred if r.doc_id in (2, 3, 4, 5))
    assert drop_near_duplicates(odd.drop("id")).count() == n - 2


def test_empty_tables(spark, odd, paths):
    none = odd.limit(0)
    for got in (shard_documents(none, 4), pack_documents(none), count_tokens(none, paths[0]), near_duplicates(none), quality_verdicts(none),
                secret_report(none), encode_pieces(none, paths[1]), predict_languages(none, fit_profiles(none)), redact_secrets(none)):
        assert got.count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert exact_search.search_report(vectors).count() == 0
    assert warc_zst.archive_report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd):
    docs = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.createDataFrame(stage(spark, docs, "").collect() or [], stage(spark, docs, "").schema)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == corpus_pipeline.COLUMNS


def test_near_duplicate_groups(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:60], f"x{i}", *base[61:]])) for i in range(80)] + [(900 + i, f"alone {i} " + " ".join(f"q{i}_{j}" for j in range(40))) for i in range(5)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert {got[i] for i in range(80)} == {0} and all(got[900 + i] == 900 + i for i in range(5))


def test_search_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1e30, 0.0]), (None, [1.0, 1.0])]
    got = exact_search.search_report(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got if r.query_id == 0] == [(0, 1, 6, 2**63 - 1), (0, 2, 1, 4096), (0, 3, 2, 4096)]


def test_best_fit_order():
    assert best_fit([(6, "a", None), (5, "b", None), (4, "c", None), (4, "a", None), (3, "d", None)], 10) == [(0, 0), (1, 0), (0, 6), (1, 5), (2, 0)]
    assert best_fit([(5, None, 1), (5, None, 1)], 10) == [(0, 0), (1, 0)]


def test_packing_sees_the_whole_table(spark):
    # sources stored one after the other, over several windows
    rows = [(i, "x" * (3000 + i % 997) + str(i), f"s{i // 2000}") for i in range(10_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pack_documents(d.coalesce(2)).toPandas()
    other = pack_documents(d.repartition(5, "text")).toPandas()
    whole = best_fit([(len(t), s, i) for i, t, s in rows], 8192)
    by_id = lambda x: x.sort_values(["doc_id", "piece"]).reset_index(drop=True)
    assert by_id(got).equals(by_id(other))
    assert got["bin_id"].nunique() <= 1.02 * (max(b for b, _ in whole) + 1)
    assert got.groupby("bin_id")["size"].sum().max() <= 8192
    named = got.merge(d.select("doc_id", "source").toPandas(), on="doc_id").sort_values(["bin_id", "bin_offset"])
    assert not named.duplicated(["bin_id", "source"]).any()
    assert (named["bin_offset"] == named.groupby("bin_id")["size"].cumsum() - named["size"]).all()


def test_language_stage_rejects_and_relabels(spark):
    words = {"en": "the house with many windows stands there and they would think about this", "de": "das schöne haus steht dort und wir werden nicht über diese straße gehen"}
    turned = lambda ws, i: " ".join(ws[(i * j + i // 7) % len(ws)] for j in range(1, 15))
    rows = [(i, turned(words[x].split(), i + 1), x) for x, at in (("en", 0), ("de", 1)) for i in range(at, 400, 2)]
    foreign = ["Η γλώσσα αυτή είναι ελληνική και δεν έχει μαθευτεί ποτέ εδώ από κανέναν άνθρωπο", "日本語の文章はここで学習されていません。" * 4, "asdf qwer zxcv hjkl uiop tyui vbnm fghj " * 3]
    rows += [(1000 + i, t, x) for i, (t, x) in enumerate([*((t, None) for t in foreign), (turned(words["de"].split(), 5), "en"), (turned(words["en"].split(), 5), None)])]
    held = [(*r[:2], r[2], "a", len(r[1])) for r in rows]
    d = spark.createDataFrame(held, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_stage(spark, d, "").collect()}
    assert not {1000, 1001, 1002} & set(got)
    assert got[1003] == "de" and got[1004] == "en"
    assert sum(i < 1000 for i in got) >= 390 and all(got[i] == x for i, _, x in rows if i in got and i < 1000)


def test_packed_numbers():
    import numpy as np

    v = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**34])
    assert unpack(pack(v)).tolist() == v.tolist() and unpack(b"").tolist() == []


def test_secrets(spark):
    key = "Abcdefghijklmnopqrstuvwxyz0123456789ABCD"
    texts = [f"id AKIA{'A1' * 8}\nkey {key}", f"{key}\n\n\nAKIA{'A1' * 8}", "password=token: abcdefgh", "token: 'abc' API_KEY=\"zzzzzz\""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secret_report(d).collect()}
    assert got[0].spans == "access:3:23,bare_key:28:68" and got[1].spans == "bare_key:0:40,access:43:63" and got[2].spans == "" and got[3].n_assign == 1
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert [r.text for r in redact_secrets(d).orderBy("doc_id").collect()][0] == "id [SECRET]\nkey [SECRET]"


def test_redaction_links_over_a_block(spark):
    key, access = "Abcdefghijklmnopqrstuvwxyz0123456789ABCD", f"AKIA{'A1' * 8}"
    texts = [
        f"[default]\naws_access_key_id = {access}\nregion = eu\noutput = json\n\naws_secret_access_key = {key}\nend",
        f"{key}\n\n{access}", f"url https://a.example/x\n\n\n\nid {access}\n\n\npassword=abcdef1", f"{key}" + "\n" * 21 + access, f"a\n\n{key}",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in redact_secrets(d).orderBy("doc_id").collect()]
    assert got[0] == "[default]\naws_access_key_id = [SECRET]\nregion = eu\noutput = json\n\naws_secret_access_key = [SECRET]\nend"
    assert got[1] == "[SECRET]\n\n[SECRET]" and got[2] == "url [SECRET]\n\n\n\nid [SECRET]\n\n\n[SECRET]"
    assert got[3] == key + "\n" * 21 + "[SECRET]" and got[4] == texts[4]
    spans = [r.spans for r in secret_report(d).orderBy("doc_id").collect()]
    assert spans[0] == "access:30:50,bare_key:102:142" and spans[3] == "access:61:81" and spans[4] == ""


def test_columns_named_like_inner_ones(spark):
    d = spark.createDataFrame([(1, "password=abcdefgh", 5, 6, 7, 8)], "doc_id long, text string, all_spans int, base_spans int, _t int, x0 int")
    assert [tuple(r) for r in redact_secrets(d).collect()] == [(1, "[SECRET]", 5, 6, 7, 8)]
    d = d.withColumns({"lang": F.lit("en"), "source": F.lit("a"), "n_words": F.lit(3)})
    got = quality_verdicts(d, keep=("doc_id", "x0", "text", "_t")).first()
    assert (got.x0, got.text, got._t, got.n_words) == (8, "password=abcdefgh", 7, 1)
    with pytest.raises(ValueError):
        quality_verdicts(d, keep=("n_words",))


def test_warc_checks(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, None, "x" * 200), (3, "v", None), (4, "w", "short"), (5, "z", "short"), (None, "n\n", "x" * 200)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc_zst.archive_report(pages).collect()}
    assert got == {1: (200, "response", None), 2: (200, "revisit", 1), 3: (0, "response", None), 4: (5, "response", None), 5: (5, "response", None), None: (200, "response", None)}
    good = warc_zst.record_bytes("response", 1, "u", hashlib.sha256(b"hi").hexdigest(), b"hi", None)
    assert warc_zst.parse_record(good)["payload"] == b"hi"
    for bad in (good[:-2], good.replace(b"hi\r\n", b"ho\r\n"), good.replace(b"WARC/1.1", b"WRAC/1.1"), good.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc_zst.WarcError):
            warc_zst.parse_record(bad)
    with pytest.raises(warc_zst.WarcError):
        list(warc_zst.read_frames(b"not an archive"))
