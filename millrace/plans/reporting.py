"""Registered queries over reports, samplers, sources, sinks and lifecycles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.functions import answers, graders
from millrace.functions import text as T
from millrace.operators import reports as R
from millrace.operators import sampling as S
from millrace.operators import sequences as Q
from millrace.plans.queries import _ALL, _GOPHER, _MASKED, masked, query, r6, table
from millrace.plans.scratch import Scratch
from millrace.sources import files, sinks


def _h(x: str) -> str:
    """DuckDB: 48 bits of the MD5 of a text."""
    return f"('0x' || substr(md5({x}), 1, 12))::BIGINT"


# --- filters and funnels ----------------------------------------------------------------------
@query(f"""WITH {_MASKED}, {_GOPHER} SELECT coalesce(CASE WHEN NOT n_words BETWEEN 50 AND 100000 THEN 'word_count' WHEN NOT coalesce(mean_length BETWEEN 3 AND 10, false) THEN 'mean_word_length'
    WHEN coalesce(dots, 0) > 0.3 THEN 'ellipsis_lines' WHEN NOT coalesce(alpha >= 0.8, false) THEN 'alphabetic_words' END, 'passed') AS reason, lang, count(*) AS n FROM g3 GROUP BY 1, 2""")
def gopher_reasons(spark, sf):
    d = masked(spark, sf).withColumn("r", F.coalesce(T.gopher_reason(T.gopher_features(F.col("masked"))), F.lit("passed")))
    return d.groupBy(F.col("r").alias("reason"), "lang").agg(F.count("*").alias("n"))


_LETTERS = r"""c AS (SELECT *, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE AS en, length(regexp_replace(text, '[^\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]', '', 'g'))::DOUBLE AS zh,
    length(regexp_replace(text, '[^\p{L}]', '', 'g'))::DOUBLE AS a FROM documents), o AS (SELECT *, greatest(a - en - zh, 0) AS other FROM c),
la AS (SELECT *, coalesce(zh + en + other > 0 AND NOT (zh >= en AND zh >= other) AND en >= other AND en / (zh + en + other) >= 0.97, false) AS english FROM o)"""


@query(f"WITH {_LETTERS} SELECT lang, count(*) AS n, count(*) FILTER (english) AS n_english FROM la GROUP BY 1")
def english_filter(spark, sf):
    d = table(spark, sf, "documents").withColumn("e", T.is_english(T.letter_language(F.col("text")), 0.97))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.coalesce("e", F.lit(False))).alias("n_english"))


@query(f"""{_ALL}, f AS (SELECT CASE WHEN length(t) < 200 THEN 'too_short' WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN NOT wiki THEN 'quality' ELSE 'retained' END AS stage FROM s2)
SELECT stage, count(*) AS n, round(count(*) / (SELECT count(*) FROM f)::DOUBLE, 6) AS share FROM f GROUP BY 1""")
def retention_funnel(spark, sf):
    d = masked(spark, sf)
    wiki = T.quality_label(T.quality_logit(T.quality_features(F.col("masked"))))["label"] == "wiki"
    tests = {"too_short": F.length("text") >= 200, "language": F.col("lang").isin("en", "de"), "quality": wiki}
    return R.funnel(d, tests).select("stage", "n", r6("share").alias("share"))


@query("SELECT o_orderpriority AS device, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1")
def valid_measurements(spark, sf):
    ok = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "5-LOW")
    return table(spark, sf, "orders").where(ok).groupBy(F.col("o_orderpriority").alias("device")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT page_id % 200 AS id, url, length(html) AS n FROM pages)
SELECT id::VARCHAR AS id, 'url_too_long' AS fault FROM s WHERE length(url) > 45 UNION ALL SELECT id::VARCHAR, 'no_text' FROM s WHERE n < 500
UNION ALL SELECT id::VARCHAR, 'duplicate id' FROM s GROUP BY id HAVING count(*) > 1 UNION ALL SELECT url, 'duplicate url' FROM s GROUP BY url HAVING count(*) > 1""")
def registry_faults(spark, sf):
    s = table(spark, sf, "pages").select((F.col("page_id") % 200).alias("id"), "url", F.length("html").alias("n"))
    return R.registry_faults(s, "id", {"url_too_long": F.length("url") <= 45, "no_text": F.col("n") >= 500}, ("id", "url"))


@query("""WITH t AS (SELECT DISTINCT p_name AS name, length(p_name) AS n FROM part), s AS (SELECT name, n, substr(name, i) AS suffix FROM t, range(1, 200) r(i) WHERE i <= n),
o AS (SELECT name, n, suffix, lag(suffix) OVER (PARTITION BY name ORDER BY suffix) AS before FROM s),
l AS (SELECT name, n, coalesce(list_max(list_filter(range(1, 200), lambda k: k <= least(length(suffix), length(before)) AND substr(suffix, 1, k) = substr(before, 1, k))), 0) AS lcp FROM o)
SELECT name, round(CASE WHEN n <= 1 THEN 0 ELSE 2.0 * sum(lcp) / (n * (n + 1)) END, 6)::DOUBLE AS score FROM l GROUP BY name, n""")
def repetition_scores(spark, sf):
    return table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct().select("name", r6(graders.repetition("name")).alias("score"))


@query()
def repetition_of_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", r6(graders.repetition("text")).alias("score"), graders.is_repetitive("text").alias("repetitive"))


# --- joins --------------------------------------------------------------------------------------
@query("""WITH m AS (SELECT o_orderstatus AS k, o_orderpriority AS v, avg(o_totalprice) AS x FROM orders GROUP BY 1, 2), t AS (SELECT k, max(x) AS x FROM m GROUP BY 1)
SELECT b.k, round(b.x, 4) AS base, round(t.x, 4) AS best, (SELECT min(v) FROM m WHERE m.k = b.k AND m.x = t.x) AS strongest, round(t.x / b.x, 6) AS ratio FROM m b JOIN t USING (k) WHERE b.v = '5-LOW'""")
def baseline_strongest(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("k"), F.col("o_orderpriority").alias("v")).agg(F.avg("o_totalprice").alias("x"))
    got = R.baseline_against_strongest(m, "k", "v", "x", "5-LOW")
    return got.select("k", F.round("x_baseline", 4).alias("base"), F.round("x_strongest", 4).alias("best"), "strongest", r6("ratio").alias("ratio"))


@query("""WITH m AS (SELECT c_mktsegment AS s, o_orderstatus AS t, o_orderpriority AS p, o_orderkey % 2 AS new, avg(o_totalprice) AS x FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
SELECT a.s, a.t, a.p, round(a.x / b.x, 6) AS speedup FROM m a JOIN m b ON a.s = b.s AND a.t = b.t AND a.p = b.p AND a.new = 0 AND b.new = 1""")
def keyed_speedups(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    m = o.groupBy(F.col("c_mktsegment").alias("s"), F.col("o_orderstatus").alias("t"), F.col("o_orderpriority").alias("p"), (F.col("o_orderkey") % 2).alias("new")).agg(F.avg("o_totalprice").alias("x"))
    return R.speedups(m.where("new = 0"), m.where("new = 1"), ["s", "t", "p"], "x").select("s", "t", "p", r6("speedup").alias("speedup"))


@query("""WITH c AS (SELECT conv_id, list(md5(text) ORDER BY turn) FILTER (role = 'user') AS u, list(md5(text) ORDER BY turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1)
SELECT conv_id, unnest(range(len(u)))::INT AS i, unnest(u) AS asked, unnest(a) AS answered FROM c WHERE len(u) = len(a)""")
def zipped_turns(spark, sf):
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", F.md5("text").alias("m"))))), lambda x: x["m"])
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(of("user").alias("u"), of("assistant").alias("a")).where(F.size("u") == F.size("a"))
    return c.select("conv_id", F.explode(R.zipped(F.col("u"), F.col("a"))).alias("x")).select("conv_id", "x.i", F.col("x.left").alias("asked"), F.col("x.right").alias("answered"))


@query("SELECT 'small' AS variant, n_name AS name, NULL::VARCHAR AS segment FROM nation UNION ALL SELECT 'large', c_name, c_mktsegment FROM customer")
def concatenated_variants(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_name").alias("name")).withColumn("variant", F.lit("small"))
    b = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).withColumn("variant", F.lit("large"))
    return a.unionByName(b, allowMissingColumns=True).select("variant", "name", "segment")


@query("SELECT event_id, list_sort(list_filter(['k', 'run_id'], lambda r: NOT list_contains(json_keys(props), r)))[1] AS missing FROM events")
def missing_keys(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get(F.array_sort(F.array_except(F.array(F.lit("k"), F.lit("run_id")), F.json_object_keys("props"))), F.lit(0)).alias("missing"))


@query("WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM f GROUP BY 1")
def ordered_distinct(spark, sf):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("roles"))


# --- aggregates ---------------------------------------------------------------------------------
@query(f"""WITH {_MASKED}, {_GOPHER}, x AS (SELECT g3.*, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS en, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS a FROM g3)
SELECT CASE WHEN a = 0 THEN '其他' WHEN en >= a - en THEN 'en' ELSE '其他' END AS label, count(*) AS n, count(*) FILTER (gopher) AS n_passed, sum(n_emails)::BIGINT AS n_emails FROM x GROUP BY 1""")
def language_passes(spark, sf):
    d = masked(spark, sf)
    d = d.select(T.letter_language(F.col("text"))["label"].alias("label"), T.gopher_pass(T.gopher_features(F.col("masked"))).alias("ok"), "n_emails")
    return d.groupBy("label").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_passed"), F.sum("n_emails").cast("long").alias("n_emails"))


@query("""WITH l AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT event_type, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std FROM l WHERE r = 1 GROUP BY 1""")
def final_rows(spark, sf):
    last = R.last_rows(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])
    return R.mean_and_deviation(last, ["event_type"], ["value"]).select("event_type", r6("value_mean").alias("value_mean"), r6("value_std").alias("value_std"))


@query("SELECT l_returnflag, l_linestatus, year(l_shipdate)::INT AS y, max(l_extendedprice) AS most FROM lineitem GROUP BY 1, 2, 3")
def largest_by_keys(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("y")).agg(F.max("l_extendedprice").alias("most"))


@query("SELECT user_id, count(*) AS n, min(value) AS least_loss, max(event_id) AS most_tokens FROM events GROUP BY 1")
def sweep_summary(spark, sf):
    return R.sweep_summary(table(spark, sf, "events"), "user_id", "value", "event_id")


@query("""SELECT role, round(avg((length(text) > 200)::INT::DOUBLE), 6) AS format_mean, round(avg((text LIKE '%the%')::INT::DOUBLE), 6) AS answer_mean,
    round(avg((length(text) > 200)::INT::DOUBLE * (text LIKE '%the%')::INT::DOUBLE), 6) AS total_mean FROM conversations GROUP BY 1""")
def reward_components(spark, sf):
    fmt, ans = (F.length("text") > 200).cast("double"), F.contains("text", F.lit("the")).cast("double")
    c = table(spark, sf, "conversations").select("role", F.struct(fmt.alias("f"), ans.alias("a"), (fmt * ans).alias("t")).alias("r"))
    return c.groupBy("role").agg(r6(F.avg("r.f")).alias("format_mean"), r6(F.avg("r.a")).alias("answer_mean"), r6(F.avg("r.t")).alias("total_mean"))


@query(r"""WITH d AS (SELECT octet_length(encode(text)) AS b, len(regexp_extract_all(text, '\S+')) AS t FROM documents), s AS (SELECT sum(b)::BIGINT AS n_bytes, sum(t)::BIGINT AS n_tokens FROM d)
SELECT n_bytes, n_tokens, round(n_bytes / n_tokens::DOUBLE, 6) AS bytes_per_token, round(n_bytes / 2.5, 3) AS bytes_per_second, round(825e9 / (n_bytes / 2.5) / 3600, 4)::DOUBLE AS corpus_hours FROM s""")
def encode_throughput(spark, sf):
    d = table(spark, sf, "documents").select(F.octet_length("text").alias("b"), F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("t"))
    got = R.throughput(d, "b", "t", 2.5)
    return got.select("n_bytes", "n_tokens", r6("bytes_per_token").alias("bytes_per_token"), F.round("bytes_per_second", 3).alias("bytes_per_second"), F.round("corpus_hours", 4).alias("corpus_hours"))


@query("SELECT role, round(avg(length(text)), 6) AS chars, round(avg(len(list_distinct(string_split(text, ' ')))::DOUBLE / len(string_split(text, ' '))), 6) AS distinct_share FROM conversations GROUP BY 1")
def generation_means(spark, sf):
    ws = F.split("text", " ", -1)
    return table(spark, sf, "conversations").groupBy("role").agg(r6(F.avg(F.length("text"))).alias("chars"), r6(F.avg(F.size(F.array_distinct(ws)) / F.size(ws))).alias("distinct_share"))


@query("WITH t AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT min(n) AS least, count(*) AS tiers FROM t")
def least_coverage(spark, sf):
    return R.least_coverage(table(spark, sf, "customer"), "c_nationkey")


@query("""WITH e AS (SELECT abs(l_extendedprice - l_quantity * 1500) AS a, abs(l_extendedprice - l_quantity * 1500) / l_extendedprice AS r FROM lineitem)
SELECT round(max(a), 4) AS max_absolute, round(quantile_cont(a, 0.99), 4) AS p99_absolute, round(quantile_cont(r, 0.99), 6) AS p99_relative, count(*) AS n, round(sum((r <= 0.5)::INT) / count(*)::DOUBLE, 6) AS share_within_half FROM e""")
def worst_errors(spark, sf):
    from millrace.operators.quantiles import exact_quantiles

    x = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("x"))
    off = F.abs(F.col("y") - F.col("x"))
    share = x.agg(F.count("*").alias("n"), r6(F.count_if(off / F.col("y") <= 0.5) / F.count("*")).alias("share_within_half"))
    p99 = lambda e, name, d: exact_quantiles(x.select(e.alias("e")), "e", [0.99]).select(F.round("value", d).alias(name))
    worst = R.relative_errors(x, "x", "y").select(F.round("max_absolute", 4).alias("max_absolute"))
    return worst.crossJoin(share).crossJoin(p99(off, "p99_absolute", 4)).crossJoin(p99(off / F.col("y"), "p99_relative", 6))  # a row each


@query("SELECT event_type, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std FROM events GROUP BY 1")
def timing_summary(spark, sf):
    return R.mean_and_deviation(table(spark, sf, "events"), ["event_type"], ["value"]).select("event_type", r6("value_mean").alias("value_mean"), r6("value_std").alias("value_std"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS stamp FROM events")
def utc_stamps(spark, sf):
    return table(spark, sf, "events").select("event_id", R.utc_stamp(F.col("ts")).alias("stamp"))


@query("SELECT event_id, ts AS at, (props::JSON->>'$.k')::DOUBLE + value AS x FROM events")
def json_casts(spark, sf):
    e = table(spark, sf, "events")
    e = e.select("event_id", F.to_json(F.struct(R.utc_stamp(F.col("ts")).alias("at"), "value", F.get_json_object("props", "$.k").alias("k"))).alias("j"))
    path = lambda p, t: F.get_json_object("j", p).cast(t)
    return e.select("event_id", path("$.at", "timestamp").cast("timestamp_ntz").alias("at"), (path("$.k", "double") + path("$.value", "double")).alias("x"))


@query("""SELECT c_custkey AS id, sha256('{"key":' || c_custkey || ',"name":"' || c_name || '","nothing":null,"region":' || c_nationkey || '}') AS digest FROM customer""")
def typed_hashes(spark, sf):
    n = table(spark, sf, "customer")
    return n.select(F.col("c_custkey").alias("id"), files.stable_hash(region=F.col("c_nationkey"), nothing=F.lit(None).cast("string"), name=F.col("c_name"), key=F.col("c_custkey")).alias("digest"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE - list_max(embedding)::DOUBLE) AS s FROM embeddings), z AS (SELECT vec_id, s, ln(list_sum(list_transform(s, lambda x: exp(x)))) AS z FROM s)
SELECT vec_id, round(-list_sum(list_transform(s, lambda x: exp(x - z) * (x - z))), 6) AS entropy, round(list_max(list_transform(s, lambda x: x - z)), 6) AS top FROM z""")
def logit_entropy(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", r6(R.entropy(F.col("embedding"))).alias("entropy"), r6(F.array_max(R.log_softmax(F.col("embedding")))).alias("top"))


@query("""SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey DESC)::INT AS position, o_orderkey FROM orders QUALIFY position <= 50""")
def ordered_listing(spark, sf):
    return R.position_listing(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.desc("o_orderkey")], 50).select("position", "o_orderkey")


@query("SELECT least(count(*), 123) AS n FROM documents WHERE lang = 'en'")
def early_stop(spark, sf):
    return table(spark, sf, "documents").where("lang = 'en'").limit(123).agg(F.count("*").alias("n"))  # the limit ends the scan early


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(p_name, '[^ ]+')) AS w FROM part) SELECT w AS token, octet_length(encode(w))::INT AS n FROM w WHERE w <> 'almond' ORDER BY n DESC, w DESC LIMIT 1""")
def longest_token(spark, sf):
    w = table(spark, sf, "part").select(F.explode(F.regexp_extract_all("p_name", F.lit("[^ ]+"), F.lit(0))).alias("w")).where("w <> 'almond'")
    return w.agg(F.max(F.struct(F.octet_length("w").alias("n"), "w")).alias("x")).select(F.col("x.w").alias("token"), "x.n")


# --- samplers ------------------------------------------------------------------------------------
@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_h("doc_id || '-' || 7")}, doc_id) - 1 AS position FROM documents")
def seeded_permutation(spark, sf):
    return S.permuted(table(spark, sf, "documents").select("doc_id"), "doc_id", 7).select("doc_id", "position")


@query(f"SELECT doc_id FROM documents ORDER BY {_h("doc_id || '-' || 3")}, doc_id LIMIT 40")
def seeded_sample(spark, sf):
    return files.seeded_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 40, 3)


@query(f"WITH n AS (SELECT sum(n_chars)::BIGINT AS n FROM documents) SELECT i, {_h("i || '-' || 5")} % (n - 256) AS start FROM n, range(500) r(i)")
def window_draws(spark, sf):
    n = table(spark, sf, "documents").agg(F.sum("n_chars")).first()[0]
    return S.window_starts(n, 256, spark.range(500).withColumnRenamed("id", "i"), 5)


@query(f"""WITH d AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT AS stop, lead(doc_id) OVER (ORDER BY doc_id) AS next, min(doc_id) OVER () AS least, sum(n_chars) OVER ()::BIGINT AS all_ FROM documents WHERE n_chars > 0)
SELECT i, coalesce(next, least) AS doc_id FROM range(300) r(i) JOIN d ON {_h("i || '-' || 0")} % all_ >= stop - n_chars AND {_h("i || '-' || 0")} % all_ < stop""")
def length_biased_sample(spark, sf):
    return S.length_biased_draws(table(spark, sf, "documents"), "doc_id", "n_chars", spark.range(300).withColumnRenamed("id", "i"))


_P = ", ".join(f"{p:.17g}::DOUBLE" for p in S.POISSON)


def _boot(unit: str, stratum: str, rounds: int) -> str:
    return f"""WITH b AS (SELECT *, {unit} AS u, {stratum} AS s FROM events), w AS (SELECT r, s, value, event_id % 10 AS other, len(list_filter([{_P}], lambda p: {_h("u || '-' || r")} / 281474976710656::DOUBLE >= p)) AS w FROM b, range({rounds}) t(r)),
p AS (SELECT r, s, count(*) AS size, sum(w * value) / nullif(sum(w), 0) AS x, sum(w * other)::DOUBLE / nullif(sum(w), 0) AS y FROM w GROUP BY 1, 2)
SELECT r::INT AS round, round(sum(size * x) / sum(CASE WHEN x IS NOT NULL THEN size END), 6) AS value, round(sum(size * y) / sum(CASE WHEN y IS NOT NULL THEN size END), 6) AS other FROM p GROUP BY 1"""


def _booted(spark, sf, unit, stratum):
    e = table(spark, sf, "events").select("event_type", "value", (F.col("event_id") % 10).alias("other"), unit.alias("u"))
    return S.bootstrap(e, ["value", "other"], "u", 12, stratum).select("round", r6("value").alias("value"), r6("other").alias("other"))


@query(_boot("event_id", "event_type", 12))
def stratified_bootstrap(spark, sf):
    return _booted(spark, sf, F.col("event_id"), "event_type")


@query(_boot("user_id", "''", 12))
def cluster_bootstrap(spark, sf):
    return _booted(spark, sf, F.col("user_id"), None)


@query(f"""WITH p AS (SELECT o_orderkey AS u, ln(o_totalprice) AS y, ln(o_custkey + 1) AS x FROM orders),
n AS (SELECT r, x, y + 0.1 * sqrt(-2 * ln(({_h("u || '-' || r || '-u'")} + 0.5) / 281474976710656::DOUBLE)) * cos(6.283185307179586 * (({_h("u || '-' || r || '-v'")} + 0.5) / 281474976710656::DOUBLE)) AS y FROM p, range(6) t(r))
SELECT r::INT AS round, round(regr_slope(y, x), 6) AS exponent FROM n GROUP BY 1""")
def jittered_exponents(spark, sf):
    o = table(spark, sf, "orders").withColumn("x", F.col("o_custkey") + 1)
    return S.jittered_exponents(o, "x", "o_totalprice", "o_orderkey", 6, 0.1).select("round", r6("exponent").alias("exponent"))


_TOKENS = """t AS (SELECT doc_id, list_concat(list_transform(string_split(text, ' '), lambda w: least(length(w), 60000)), [50256]) AS ids FROM documents),
x AS (SELECT doc_id, unnest(ids) AS token, unnest(range(len(ids))) AS i FROM t), tokens AS (SELECT token, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM x)"""


def _token_files(spark, sf):
    """The folder of token files written from all documents in the order of their ids, and the number of tokens."""
    d = table(spark, sf, "documents").withColumn("ids", F.transform(F.split("text", " ", -1), lambda w: F.least(F.length(w), F.lit(60_000))))
    scratch = Scratch(spark, "tokenfiles")
    made = scratch.save(sinks.write_token_files(d.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), scratch.path("files"), 50256), "made")
    return scratch.path("files"), made.agg(F.sum("tokens")).first()[0] or 0


@query(f"""WITH {_TOKENS}, n AS (SELECT count(*) // 2048 AS chunks FROM tokens),
p AS (SELECT chunk, s AS sequence, chunk * 16 + row_number() OVER (PARTITION BY chunk ORDER BY {_h("chunk || '-' || s")}, s) - 1 AS i FROM n, LATERAL (SELECT unnest(range(chunks)) AS chunk), range(16) b(s)),
q AS (SELECT p.* FROM p, n WHERE i BETWEEN chunks * 16 // 4 AND chunks * 16 // 4 + chunks * 16 // 2 - 1)
SELECT i, chunk, sequence::INT AS sequence, sum(token)::BIGINT AS total FROM q JOIN tokens ON pos // 128 = chunk * 16 + sequence GROUP BY ALL""")
def permuted_reads(spark, sf):
    """The middle half of all sequences of 128 tokens, permuted within chunks of 16, with their tokens read from the files."""
    from millrace.sources.splits import read_tokens

    folder, n = _token_files(spark, sf)
    chunks = n // 2048
    reads = S.permuted_reads(spark.range(chunks).withColumnRenamed("id", "chunk"), 16, chunks * 16 // 4, chunks * 16 // 2)
    # whole chunks are read: the sequences of a chunk lie together
    span = [(chunks * 4 // 16 * 2048, -(-(chunks * 16 // 4 + chunks * 16 // 2) // 16) * 2048)]
    tokens = read_tokens(spark, folder, span).groupBy(F.floor(F.col("pos") / 128).alias("at")).agg(F.sum("token").alias("total"))
    return reads.join(tokens, F.col("chunk") * 16 + F.col("sequence") == F.col("at")).select("i", "chunk", "sequence", "total")


# --- sequences -------------------------------------------------------------------------------------
@query("""WITH o AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT AS stop FROM documents)
SELECT count(*) FILTER (stop <= 100000) AS completed, coalesce(max(stop) FILTER (stop <= 100000), 0) AS tokens, least(sum(n_chars), 100000)::BIGINT - coalesce(max(stop) FILTER (stop <= 100000), 0) AS partial FROM o""")
def budget_search(spark, sf):
    o = Q.offsets(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars")
    return R.within_budget(o, "start", "n_chars", 100_000, "doc_id")


@query("""WITH RECURSIVE e AS (SELECT doc_id, n_chars AS n, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
g AS (SELECT doc_id, n, i, 0::BIGINT AS run, n::BIGINT AS used FROM e WHERE i = 1
UNION ALL SELECT e.doc_id, e.n, e.i, CASE WHEN g.used + e.n > 16384 THEN g.run + 1 ELSE g.run END, CASE WHEN g.used + e.n > 16384 THEN e.n ELSE g.used + e.n END FROM g JOIN e ON e.i = g.i + 1)
SELECT doc_id, run FROM g""")
def ordered_runs(spark, sf):
    return Q.ordered_runs(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 16384).select("doc_id", F.col("pack").alias("run"))


_WIDTHS = lambda t: f"list_transform(string_split({t}, ' '), lambda w: length(w)::INT)"


@query(f"""WITH t AS (SELECT u.conv_id, u.turn, {_WIDTHS("u.text")} AS p, {_WIDTHS("a.text")} AS r FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
c AS (SELECT conv_id, turn, list_concat(p, r, [999], list_transform(range(64), lambda i: 0)) AS ids, list_concat(list_transform(p, lambda x: -100), r, [999], list_transform(range(64), lambda i: -100)) AS labels, len(p) + len(r) + 1 AS n FROM t)
SELECT conv_id, turn, array_to_string(ids[1:64], ' ') AS input_ids, array_to_string(labels[1:64], ' ') AS labels, least(n, 64)::INT AS n_attended FROM c""")
def collated_turns(spark, sf):
    c = table(spark, sf, "conversations")
    widths = lambda t: F.transform(F.split(t, " ", -1), lambda w: F.length(w))
    u = c.where("role = 'user'").select("conv_id", "turn", widths("text").alias("p"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), widths("text").alias("r"))
    x = u.join(a, ["conv_id", "turn"]).withColumn("x", R.collated(F.col("p"), F.col("r"), 999, 0, 64))
    said = lambda col: F.array_join(F.transform(col, lambda v: v.cast("string")), " ")
    return x.select("conv_id", "turn", said("x.input_ids").alias("input_ids"), said("x.labels").alias("labels"), F.aggregate("x.attention", F.lit(0), lambda s, v: s + v).alias("n_attended"))


@query("SELECT doc_id, len(string_split(text, ' ')) + 1 AS n_tokens, 50256 AS last FROM documents")
def with_end_marks(spark, sf):
    ids = F.concat(F.transform(F.split("text", " ", -1), lambda w: F.length(w)), F.array(F.lit(50256)))
    return table(spark, sf, "documents").select("doc_id", ids.alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.element_at("ids", -1).alias("last"))


@query("""WITH b AS (SELECT b, b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 AS shown FROM range(256) r(b))
SELECT b AS byte, CASE WHEN shown THEN b ELSE 255 + row_number() OVER (PARTITION BY shown ORDER BY b) END AS point FROM b""")
def byte_letters(spark, sf):
    return spark.createDataFrame([(b, ord(c)) for b, c in sinks.byte_letters().items()], "byte long, point long")


@query(r"""WITH s AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '(ander|and|the)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda p: p <> '') AS p FROM conversations)
SELECT conv_id, turn, len(p)::INT AS n_pieces, len(list_filter(p, lambda x: x IN ('and', 'the', 'ander')))::INT AS n_special, md5(array_to_string(p, '|')) AS pieces_md5 FROM s""")
def special_pieces(spark, sf):
    specials = ("and", "the", "ander", "and")
    c = table(spark, sf, "conversations").withColumn("p", R.special_split(F.col("text"), specials))
    return c.select("conv_id", "turn", F.size("p").alias("n_pieces"), F.size(F.filter("p", lambda x: x.isin(*specials))).alias("n_special"), F.md5(F.array_join("p", "|")).alias("pieces_md5"))


# --- text and answers ------------------------------------------------------------------------------
@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?:https?|ftp)://[\w/#~:.?+=&%@!\-]+[\w/#]'))::INT AS n, regexp_extract(html, '(?:https?|ftp)://[\w/#~:.?+=&%@!\-]+[\w/#]') AS first FROM pages""")
def reference_urls(spark, sf):
    from millrace.sources.web import links

    p = table(spark, sf, "pages").withColumn("l", links(F.col("html")))
    return p.select("page_id", F.size("l").alias("n"), F.coalesce(F.get("l", F.lit(0)), F.lit("")).alias("first"))


@query("""WITH l AS (SELECT event_id, '__label__' || CASE event_id % 4 WHEN 0 THEN 'Hate_Speech' WHEN 1 THEN 'TOXIC' WHEN 2 THEN 'neutral' ELSE 'porn' END AS l FROM events)
SELECT event_id, replace(lower(substr(l, 10)), '_', '-') AS label, CASE WHEN event_id % 4 IN (0, 1) THEN 'toxic' ELSE 'non-toxic' END AS toxic, CASE WHEN event_id % 4 = 3 THEN 'nsfw' ELSE 'non-nsfw' END AS nsfw FROM l""")
def model_labels(spark, sf):
    names = F.array(*map(F.lit, ("Hate_Speech", "TOXIC", "neutral", "porn")))
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("__label__"), F.get(names, (F.col("event_id") % 4).cast("int"))).alias("l"))
    return e.select("event_id", files.plain_label(F.col("l")).alias("label"), files.safety_outcome("toxic", F.col("l")).alias("toxic"), files.safety_outcome("nsfw", F.col("l")).alias("nsfw"))


@query("""SELECT event_id // 2 AS item, min((event_id % 5 = event_id % 3)::INT)::DOUBLE AS score FROM events GROUP BY 1""")
def circular_scores(spark, sf):
    # options A to C hold three texts; a response names a letter, a text, or (4 of 5) nothing of either
    e = table(spark, sf, "events").select(F.floor(F.col("event_id") / 2).alias("item"), (F.col("event_id") % 3).cast("int").alias("right"), (F.col("event_id") % 5).cast("int").alias("said"))
    options = F.array(*[F.struct(F.lit(c).alias("letter"), F.lit(t).alias("text")) for c, t in (("A", "Red Kite"), ("B", "blue heron"), ("C", "Grey, owl!"))])
    says = F.array(*map(F.lit, ("(A) it is.", "surely the BLUE  heron", "grey owl", "none of these", "no idea")))
    x = e.select("item", F.get(says, "said").alias("response"), options.alias("options"), F.get(F.array(*map(F.lit, "ABC")), "right").alias("gold"))
    return R.circular_scores(x, "item")


@query(r"""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '<answer> 42 </answer>' WHEN 1 THEN '42 42 <answer>42</answer>' WHEN 2 THEN 'so <answer>41</answer>' ELSE 'it is 42' END AS r FROM events)
SELECT event_id, (CASE WHEN event_id % 4 IN (0, 2) THEN 0.1 ELSE 0 END)::DOUBLE AS format, (CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END)::DOUBLE AS answer, (CASE event_id % 4 WHEN 0 THEN 1.1 WHEN 2 THEN 0.1 ELSE 0 END)::DOUBLE AS total FROM r""")
def guarded_rewards(spark, sf):
    says = F.array(*map(F.lit, ("<answer> 42 </answer>", "42 42 <answer>42</answer>", "so <answer>41</answer>", "it is 42")))
    e = table(spark, sf, "events").select("event_id", F.get(says, (F.col("event_id") % 4).cast("int")).alias("r"))
    return e.select("event_id", answers.guarded_reward(F.col("r"), F.lit("42"), F.trim).alias("x")).select("event_id", "x.*")


# what is answered about an order's customer number c, what is true, and whether that is right
_ANSWERS = (
    (r"'\\frac{' || c || '}{7}'", "c || '/7'", 1), (r"'\\dfrac{' || 2 * c || '}{14}'", "c || '/7'", 0), ("t", "c", 1), ("c || '.0'", "c", 1), ("c || '.5'", "(2 * c + 1) || '/2'", 1),
    (r"'\\left(' || c || ', ' || (c + 1) || '\\right)'", "'(' || c || ',' || (c + 1) || ')'", 1), ("'[' || c || ',' || (c + 1) || ')'", "'(' || c || ',' || (c + 1) || ')'", 0),
    (r"c || '\\text{ cm}'", "c", 1), ("c || ' 3/4'", "(4 * c + 3) || '/4'", 1), ("(4 * c) || '/4'", "c", 0), ("'x = ' || c", "c", 1), ("c + 1", "c", 0), (r"'\\$' || t || '\\%'", "c", 1),
    (r"c || '^{\\circ}'", r"'\\boxed{' || c || '}'", 1), ("c || '.0001'", "c || '.0002'", 0), ("c || ' miles'", "(c + 1) || ' miles'", 0), (r"c || '\\frac12'", "c || '.5'", 1),
)
_PAIRS = lambda q: "CASE o_orderkey % 17 " + " ".join(f"WHEN {i} THEN {q(a)}" for i, a in enumerate(_ANSWERS)) + " END"
_RIGHT = _PAIRS(lambda a: str(a[2]))


def _answered(spark, sf):
    """Orders with a given and a true answer in seventeen forms over all customer numbers."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("c"), F.format_number("o_custkey", 0).alias("t"))
    text = lambda k: F.expr(_PAIRS(lambda a: f"CAST({a[k]} AS STRING)").replace("2 * c", "2 * bigint(c)").replace("4 * c", "4 * bigint(c)").replace("c + 1", "bigint(c) + 1"))
    return o.select("o_orderkey", text(0).alias("given"), text(1).alias("truth"))


@query(f"""SELECT o_orderkey, (o_orderkey % 5 <> 0)::INT::DOUBLE AS format_reward, ({_RIGHT} * (o_orderkey % 5 <> 0)::INT)::DOUBLE AS answer_reward, ({_RIGHT} * (o_orderkey % 5 <> 0)::INT)::DOUBLE AS reward FROM orders""")
def boxed_rewards(spark, sf):
    says = F.when(F.col("o_orderkey") % 5 == 0, F.col("given")).otherwise(F.concat(F.lit("so \\boxed{0} or \\boxed{"), "given", F.lit("}.")))
    return _answered(spark, sf).select("o_orderkey", answers.boxed_rewards(says, F.col("truth")).alias("x")).select("o_orderkey", "x.format_reward", "x.answer_reward", "x.reward")


@query(f"""SELECT o_orderkey, (o_orderkey % 4 <> 0)::INT::DOUBLE AS format_reward, ({_RIGHT} * (o_orderkey % 4 <> 0)::INT)::DOUBLE AS answer_reward, ({_RIGHT} * (o_orderkey % 4 <> 0)::INT)::DOUBLE AS reward FROM orders""")
def format_rewards(spark, sf):
    boxed = F.concat(F.lit("</think> <answer>thus \\boxed{"), "given", F.lit("}</answer>"))
    plain = F.concat(F.lit("a<answer></think> <answer>"), "given", F.lit("</answer>"))
    says = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("<answer>"), "given", F.lit("</answer>"))).when(F.col("o_orderkey") % 4 == 1, boxed).otherwise(plain)
    return _answered(spark, sf).select("o_orderkey", answers.format_rewards(says, F.col("truth")).alias("x")).select("o_orderkey", "x.format_reward", "x.answer_reward", "x.reward")


_QUANTITIES = r"""CASE o_orderkey % 5 WHEN 0 THEN 'an order of \$' || o_custkey || ' dollars' WHEN 1 THEN 'so $' || o_custkey || ',000$ units' WHEN 2 THEN '\frac' || o_custkey || '\sqrt' || o_custkey
WHEN 3 THEN '\text{' || o_orderpriority || '}\boxed{' || o_custkey || '}' ELSE o_custkey || ' \mathrm{th}, \text{and}' || o_orderstatus END"""


def _sql_replaced(text: str) -> str:
    for old, new in (*answers.REPLACED, *((x, "") for x in answers.REMOVED)):
        text = "replace({}, '{}', '{}')".format(text, old.replace("'", "''"), new)
    return text


@query(rf"""WITH a AS (SELECT o_orderkey, {_sql_replaced(f"({_QUANTITIES})")} AS s FROM orders),
b AS (SELECT o_orderkey, regexp_replace(regexp_replace(CASE WHEN s LIKE '%$%$%' THEN split_part(s, '$', 2) ELSE s END, '\\text\{{(.*?)\}}', '\1', 'g'), '\\boxed\{{(.*)\}}', '\1', 'g') AS s FROM a),
c AS (SELECT o_orderkey, replace(regexp_replace(regexp_replace(s, 'frac([^{{])(.)', 'frac{{\1}}{{\2}}', 'g'), 'sqrt([^{{])', 'sqrt{{\1}}', 'g'), '$', '') AS s FROM b)
SELECT o_orderkey, CASE WHEN regexp_full_match(replace(s, ',', ''), '[0-9]+') THEN replace(s, ',', '') ELSE s END AS final FROM c""")
def final_spellings(spark, sf):
    text = F.expr(_QUANTITIES.replace("\\", "\\\\"))
    return table(spark, sf, "orders").select("o_orderkey", answers.spellings(text)["final"].alias("final"))


@query("""SELECT l_orderkey, l_linenumber, abs(l_extendedprice - round(l_extendedprice, -1)) <= 1e-4 * greatest(abs(l_extendedprice), abs(round(l_extendedprice, -1))) AS close FROM lineitem""")
def close_numbers(spark, sf):
    x = table(spark, sf, "lineitem")
    return x.select("l_orderkey", "l_linenumber", answers.close_numbers(F.col("l_extendedprice"), F.round("l_extendedprice", -1)).alias("close"))


@query("""WITH p AS (SELECT l_quantity AS x, avg(l_extendedprice) + 5000 AS y FROM lineitem GROUP BY 1), f AS (SELECT f::DOUBLE AS f FROM range(0, 6000, 500) r(f)),
s AS (SELECT f, exp(regr_intercept(ln(y - f), ln(x))) AS c, regr_slope(ln(y - f), ln(x)) AS e, regr_syy(ln(y - f), ln(x)) - pow(regr_sxy(ln(y - f), ln(x)), 2) / regr_sxx(ln(y - f), ln(x)) AS sse FROM p JOIN f ON y > f GROUP BY f HAVING count(*) = (SELECT count(*) FROM p))
SELECT f AS floor, round(c, 4) AS coefficient, round(e, 6) AS exponent FROM s ORDER BY sse, f LIMIT 1""")
def free_floor_fit(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg((F.avg("l_extendedprice") + 5000).alias("y"))
    return R.free_floor_fit(p, "x", "y", [500.0 * i for i in range(12)]).select("floor", F.round("coefficient", 4).alias("coefficient"), r6("exponent").alias("exponent"))


@query()
def floor_law_fit(spark, sf):
    """Mean price of a quantity's line items as a floor and a falling power of the quantity's inverse."""
    from millrace.operators.scaling import floor_law_fit as fit

    p = table(spark, sf, "lineitem").groupBy((F.lit(51.0) - F.col("l_quantity")).alias("x")).agg(F.avg("l_extendedprice").alias("y"))
    return fit(p, "x", "y").select(F.round("floor", 2).alias("floor"), F.round("coefficient", 2).alias("coefficient"), r6("exponent").alias("exponent"))


# --- sources and sinks ------------------------------------------------------------------------------
@query("""WITH t AS (SELECT doc_id, list_concat(list_transform(string_split(text, ' '), lambda w: length(w)), [50256]) AS ids, octet_length(encode(text)) AS b FROM documents)
SELECT count(*) AS docs, sum(len(ids))::BIGINT AS tokens, sum(b)::BIGINT AS text_bytes, min(list_min(ids))::BIGINT AS least, max(list_max(ids))::BIGINT AS most, round(sum(b) / sum(len(ids))::DOUBLE, 6) AS bytes_per_token, 2 * sum(len(ids))::BIGINT AS file_bytes FROM t""")
def token_file_totals(spark, sf):
    d = table(spark, sf, "documents").withColumn("ids", F.transform(F.split("text", " ", -1), lambda w: F.length(w)))
    scratch = Scratch(spark, "tokenfiles")
    made = scratch.save(sinks.write_token_files(d, scratch.path("files"), 50256), "made")
    held = spark.read.format("binaryFile").load(scratch.path("files")).join(made.select("name"), F.col("path").endswith(F.col("name"))).agg(F.sum("length").alias("file_bytes"))
    return sinks.encode_metrics(made, 1.0).select("docs", "tokens", "text_bytes", "least", "most", r6("bytes_per_token").alias("bytes_per_token")).crossJoin(held)


@query(f"""WITH {_TOKENS} SELECT pos // 1000 AS "window", sum(token)::BIGINT AS total, count(*) AS n, min(token) FILTER (pos % 1000 = 0)::INT AS first FROM tokens GROUP BY 1""")
def token_windows(spark, sf):
    """Token files written from all documents, read again by position; every other piece in a read of its own."""
    from millrace.sources.splits import read_tokens

    folder, n = _token_files(spark, sf)
    cuts = [n * k // 20 for k in range(21)]
    pieces = [read_tokens(spark, folder, list(zip(cuts, cuts[1:]))[k::2], split_tokens=1 << 20) for k in range(2)]
    own = pieces[0].unionByName(pieces[1]).withColumn("window", F.floor(F.col("pos") / 1000))
    first = F.max(F.when(F.col("pos") % 1000 == 0, F.col("token")))
    return own.groupBy("window").agg(F.sum("token").alias("total"), F.count("*").alias("n"), first.alias("first"))


@query("SELECT url, sha256(coalesce(html, '')) AS digest, count(*) AS n FROM pages GROUP BY 1, 2")
def archive_splits(spark, sf):
    """Pages written to compressed archives, whose records are read again in ranges of 64 KB."""
    from millrace.sources.splits import read_archives

    p = table(spark, sf, "pages").select(F.lit("response").alias("rec_type"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    scratch = Scratch(spark, "archives")
    scratch.save(sinks.write_archives(p, scratch.path("files")), "made")
    read = read_archives(spark, scratch.path("files"), split_bytes=1 << 16)
    return read.groupBy(F.col("headers")["warc-target-uri"].alias("url"), F.sha2("payload", 256).alias("digest")).agg(F.count("*").alias("n"))


@query("SELECT s_name AS name, octet_length(encode(s_name)) AS n_bytes, sha256(s_name) AS sha256 FROM supplier")
def file_per_input(spark, sf):
    from millrace.sources.web import file_manifest

    scratch = Scratch(spark, "texts")
    made = scratch.save(sinks.write_texts(table(spark, sf, "supplier"), scratch.path("files"), "s_name", "s_name"), "made")
    told = file_manifest(spark, scratch.path("files")).select(F.regexp_replace(F.url_decode(F.element_at(F.split("path", "/"), -1)), r"\+", " ").alias("name"), "sha256")
    return made.join(told, "name").select("name", "n_bytes", "sha256")


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS region FROM customer")
def json_round_trip(spark, sf):
    scratch = Scratch(spark, "json")
    n = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("region"))
    sinks.append_jsonl(n.where("region < 10"), scratch.path("log"))
    sinks.append_jsonl(n.where("region >= 10"), scratch.path("log"))
    return files.read_json(spark, scratch.path("log"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in n.schema))


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer")
def csv_round_trip(spark, sf):
    scratch = Scratch(spark, "csv")
    sinks.write_csv_log(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("name")), scratch.path("log"))
    return files.read_strict_csv(spark, scratch.path("log"), ["id", "name"])


@query("SELECT event_type AS label, CASE WHEN event_type IN ('click', 'view') THEN '1e+18' ELSE '6e+18' END AS budget, count(*) AS n, max(event_id) AS last_step, min(value) AS least FROM events GROUP BY 1, 2")
def discovered_runs(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.col("event_id").alias("step"), "value")
    scratch = Scratch(spark, "runs")
    budget = F.when(F.col("event_type").isin("click", "view"), "1e+18").otherwise("6e+18")
    e.withColumn("run", F.concat(F.lit("c"), budget, F.lit("-"), "event_type")).write.partitionBy("run").json(scratch.path("all"))
    found = files.discover_runs(spark, scratch.path("all"), "step long, value double", "*.json", r"c([0-9]e(?:[+]|%2B)[0-9]+)-([^/]+)/[^/]*$")
    return found.groupBy("label", F.replace("budget", F.lit("%2B"), F.lit("+")).alias("budget")).agg(F.count("*").alias("n"), F.max("step").alias("last_step"), F.min("value").alias("least"))


@query(f"""SELECT row_number() OVER (ORDER BY {_h("url || '-' || 2")}, url) AS place, url FROM (SELECT DISTINCT url FROM pages)""")
def shuffled_listing(spark, sf):
    names = table(spark, sf, "pages").select(F.col("url").alias("path")).distinct()
    listed = files.shuffled_listing(names, "", 2).select("path")
    return S.permuted(listed, "path", 2).select((F.col("position") + 1).alias("place"), F.col("path").alias("url"))


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), ' ') AS names FROM pages""")
def listing_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(files.listing_names(F.col("html"), '[^"]*'), " ").alias("names"))


# --- streams -----------------------------------------------------------------------------------------
@query("SELECT event_id, user_id, value FROM events")
def stream_distinct(spark, sf):
    from millrace.plans.queries import _drained
    from millrace.streaming import events as E

    e = E.event_stream(spark, sf)
    return _drained(spark, "stream_distinct", E.distinct_events(e.unionByName(e))).select("event_id", "user_id", "value")


@query("""WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS began FROM events)
SELECT began, event_type, count(*) AS n FROM w WHERE began + INTERVAL 1 DAY <= (SELECT max(date_trunc('millisecond', ts)) - INTERVAL 2 DAY FROM events) GROUP BY 1, 2""")
def stream_sliding(spark, sf):
    from millrace.plans.queries import _drained
    from millrace.streaming import events as E

    out = _drained(spark, "stream_sliding", E.tumbling(E.event_stream(spark, sf), "1 day", "2 days", "12 hours"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("began"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(date_trunc('millisecond', ts)) - INTERVAL 2 DAY FROM events)""")
def stream_sessions(spark, sf):
    from millrace.plans.queries import _drained
    from millrace.streaming import events as E

    out = _drained(spark, "stream_sessions", E.sessions(E.event_stream(spark, sf)))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("began"), "n")


_KINDS = "CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'val_loss' WHEN 3 THEN 'completed' ELSE 'failed' END"


@query(f"""WITH RECURSIVE e AS (SELECT event_id AS id, user_id AS entity, {_KINDS} AS kind, 'r' || (event_id % 2) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
m AS (SELECT id, entity, kind, 'new' AS before, i, kind = 'queued' AS accepted, run_id, '' AS own FROM e WHERE i = 1
UNION ALL SELECT id, entity, kind, before, i, CASE WHEN kind = 'val_loss' THEN before = 'running' AND run_id = own ELSE (before || '>' || kind) IN ('new>queued', 'queued>running') OR (before || '>' || kind) IN ('running>completed', 'running>failed') AND run_id = own END, run_id, own FROM (
SELECT e.id, e.entity, e.kind, CASE WHEN m.accepted AND m.kind <> 'val_loss' THEN m.kind ELSE m.before END AS before, e.i, e.run_id, CASE WHEN m.accepted AND m.kind = 'running' THEN m.run_id ELSE m.own END AS own FROM m JOIN e ON e.entity = m.entity AND e.i = m.i + 1))
SELECT id, entity, kind, before, accepted FROM m""")
def stream_lifecycle(spark, sf):
    from millrace.plans.queries import _drained
    from millrace.streaming import events as E
    from millrace.streaming import lifecycle as L

    e = E.event_stream(spark, sf).select(F.col("event_id").alias("id"), F.col("user_id").alias("entity"), F.col("ts").alias("at"), F.expr(_KINDS).alias("kind"), F.concat(F.lit("r"), (F.col("event_id") % 2).cast("string")).alias("run_id"))
    return _drained(spark, "stream_lifecycle", L.run_lifecycle(e))


@query("""WITH d AS (SELECT user_id AS entity, max(epoch_us(ts) // 1000) AS last_beat, max(epoch_us(ts) // 1000 + 3600 * 1050 + 10000) AS deadline FROM events GROUP BY 1)
SELECT entity, last_beat, deadline FROM d WHERE deadline <= (SELECT max(epoch_us(ts) // 1000) FROM events)""")
def stream_silent_runs(spark, sf):
    from millrace.plans.queries import _drained
    from millrace.streaming import events as E
    from millrace.streaming import lifecycle as L

    beats = E.event_stream(spark, sf).select(F.col("user_id").alias("entity"), F.col("ts").alias("at"), F.lit(3600.0).alias("max_seconds"))
    return _drained(spark, "stream_silent_runs", L.silent_runs(beats))
