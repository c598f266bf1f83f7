"""Registered queries of scaling laws, preferences, checks and text forms, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.functions import formats as X
from millrace.operators import checks as K
from millrace.operators import preferences as P
from millrace.operators import scaling as L
from millrace.operators import sequences as Q
from millrace.plans.queries import query, r6, table

# --- text forms -----------------------------------------------------------------------


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '\p{P}', ' ', 'g'), '\s+', ' ', 'g'))) AS folded_md5 FROM documents""")
def folded_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.folded("text")).alias("folded_md5"))


@query(r"""SELECT doc_id, md5(replace(regexp_replace(regexp_replace(text, '(\p{Nd})', '\1' || chr(1), 'g'), chr(1) || '(\p{Nd})', ' \1', 'g'), chr(1), '')) AS single_md5,
md5(replace(regexp_replace(regexp_replace(text, '(\p{Nd}{1,3})', '\1' || chr(1), 'g'), chr(1) || '(\p{Nd})', ' \1', 'g'), chr(1), '')) AS triple_md5 FROM documents""")
def digit_groups(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(X.split_digits(t)).alias("single_md5"), F.md5(X.split_digits(t, 3)).alias("triple_md5"))


@query("""SELECT u.conv_id, u.turn, md5('Below is an instruction that describes a task. Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10) || u.text || chr(10) || chr(10) || '### Response:' || chr(10) || a.text) AS prompt_md5
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1""")
def instruction_prompts(spark, sf):
    c = table(spark, sf, "conversations")
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.join(a, ["conv_id", "turn"]).select("conv_id", "turn", F.md5(X.instruction_prompt(F.col("text"), F.col("answer"))).alias("prompt_md5"))


@query("""SELECT source, avg((NOT starts_with(lower(trim(CASE WHEN toxic = 1 THEN ' True, unsafe' ELSE 'false' END)), 'true'))::INT::DOUBLE) AS safe FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def safety_rate(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    verdict = F.when(F.col("toxic") == 1, " True, unsafe").otherwise("false")
    return d.groupBy("source").agg(F.avg(X.is_safe(verdict).cast("double")).alias("safe"))


def _sql_short(n: str, scales) -> str:
    out = f"({n})::VARCHAR"
    for scale, suffix in reversed(scales):
        t = f"({n} * 10 // {scale} + (({n} * 10 % {scale}) * 2 > {scale} OR (({n} * 10 % {scale}) * 2 = {scale} AND ({n} * 10 // {scale}) % 2 = 1))::INT)"
        out = f"CASE WHEN {n} >= {scale} THEN ({t} // 10)::VARCHAR || CASE WHEN {t} % 10 <> 0 THEN '.' || ({t} % 10)::VARCHAR ELSE '' END || '{suffix}' ELSE {out} END"
    return out


@query(f"SELECT doc_id, {_sql_short('(n_chars * n_chars)', X.THOUSANDS)} AS params, {_sql_short('(n_chars * 512)', X.BINARY)} AS bytes FROM documents")
def short_numbers(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", X.short_number(n * n).alias("params"), X.short_number(n * 512, X.BINARY).alias("bytes"))


# --- checks ---------------------------------------------------------------------------
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


@query(rf"""WITH p AS (SELECT page_id, {_HOST} AS host FROM pages), e AS (SELECT DISTINCT regexp_extract(host, '[^.]+\.[^.]+\.[^.]+$', 0) AS domain FROM p WHERE substr(md5(host), 1, 1) < '4')
SELECT page_id, EXISTS (SELECT 1 FROM e WHERE e.domain <> '' AND (host = e.domain OR ends_with(host, '.' || e.domain))) AS listed FROM p""")
def url_blacklist(spark, sf):
    from millrace.functions.text import url_host

    p = table(spark, sf, "pages")
    hosts = p.select(url_host(F.col("url")).alias("h")).where(F.substring(F.md5("h"), 1, 1) < "4")
    entries = hosts.select(F.regexp_extract("h", r"[^.]+\.[^.]+\.[^.]+$", 0).alias("domain")).distinct()
    return K.listed_hosts(p, entries, "page_id")


@query("""WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS day FROM events), n AS (SELECT *, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS nxt FROM d)
SELECT user_id, day + 1 AS "first", nxt - 1 AS "last" FROM n WHERE nxt > day + 1""")
def day_gaps(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"))
    return K.numbering_gaps(e, "user_id", "day")


@query("""SELECT l.conv_id, t AS target FROM (SELECT DISTINCT conv_id, 'notes/' || turn || '.md' AS t FROM conversations WHERE turn % 5 <> 4) l WHERE t NOT IN (SELECT 'notes/' || n_nationkey || '.md' FROM nation WHERE n_nationkey % 2 = 0)""")
def broken_links(spark, sf):
    turn = F.col("turn").cast("string")
    to = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("https://example.org/"), turn)).otherwise(F.concat(F.lit("notes/"), turn, F.lit(".md#top")))
    c = table(spark, sf, "conversations").select("conv_id", F.concat(F.lit("see [it]("), to, F.lit(") and [top](#top)")).alias("text"))
    held = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("notes/"), F.col("n_nationkey").cast("string"), F.lit(".md")).alias("path"))
    return K.broken_links(c, held, "conv_id", "text")


@query("SELECT doc_id FROM documents WHERE lang IN (SELECT lang FROM documents WHERE n_chars > 3000) AND source IN (SELECT source FROM documents WHERE n_chars > 3000)")
def paired_membership(spark, sf):
    d = table(spark, sf, "documents")
    return K.in_both(d.select("doc_id", "lang", "source"), d.where("n_chars > 3000"), ["lang", "source"]).select("doc_id")


# --- scaling --------------------------------------------------------------------------
def _runs(spark, sf):
    """Line items seen as training runs: parts give sizes, quantities give tokens."""
    status = F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed")
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run"), ((F.col("l_partkey") % 50 + 1) * 1e6).alias("parameters"),
        (F.col("l_quantity") * 1e8).alias("tokens"), (1.7 + F.col("l_extendedprice") / 1e5).alias("loss"), status.alias("status"),
    )


_RUNS = """r AS (SELECT l_orderkey * 10 + l_linenumber AS run, (l_partkey % 50 + 1) * 1e6::DOUBLE AS parameters, l_quantity * 1e8::DOUBLE AS tokens, 1.7::DOUBLE + l_extendedprice / 1e5::DOUBLE AS loss,
    CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END AS status FROM lineitem)"""


@query(f"""WITH {_RUNS}, t AS (SELECT *, round(log10(6 * parameters * tokens), 1) AS tier FROM r WHERE status = 'completed'), b AS (SELECT *, min(parameters) OVER w AS lo, max(parameters) OVER w AS hi FROM t WINDOW w AS (PARTITION BY tier))
SELECT tier, parameters, tokens, round(loss, 7) AS loss, parameters IN (lo, hi) AS boundary FROM b QUALIFY row_number() OVER (PARTITION BY tier ORDER BY loss, run) = 1""")
def tier_optima(spark, sf):
    return L.tier_optima(_runs(spark, sf), "run").withColumn("loss", F.round("loss", 7))


@query("""SELECT o_orderkey, round(sqrt(o_totalprice * 1e15 / 120) / 1e6, 4) AS n_m, round(20 * sqrt(o_totalprice * 1e15 / 120) / 1e6, 4) AS d_m,
round(power(0.34 * 406.4 / (0.28 * 410.7) * power(o_totalprice * 1e15 / 6, 0.28), 1 / 0.62) / 1e6, 4) AS joint_m FROM orders""")
def budget_optima(spark, sf):
    c = F.col("o_totalprice") * 1e15
    n = L.compute_optimum(c)
    joint = L.joint_optimum(c, 406.4, 410.7, 0.34, 0.28)["parameters"]
    return table(spark, sf, "orders").select("o_orderkey", *[F.round(x / 1e6, 4).alias(k) for k, x in (("n_m", n["parameters"]), ("d_m", n["tokens"]), ("joint_m", joint))])


@query(f"""WITH {_RUNS}, g AS (SELECT x.v AS x, y.v AS y FROM (SELECT unnest([1e6, 3e6, 1e7, 3e7, 5e7])::DOUBLE AS v) x, (SELECT unnest([1e8, 1e9, 5e9])::DOUBLE AS v) y),
w AS (SELECT x, y, loss, exp(-(power(ln(parameters) - ln(x), 2) + power(ln(tokens) - ln(y), 2)) / 1.5) AS w FROM r, g)
SELECT x, y, round(sum(w * loss) / sum(w), 6) AS z FROM w GROUP BY 1, 2""")
def loss_surface(spark, sf):
    r = _runs(spark, sf).select(F.col("parameters").alias("x"), F.col("tokens").alias("y"), F.col("loss").alias("z"))
    return L.kernel_surface(r, [1e6, 3e6, 1e7, 3e7, 5e7], [1e8, 1e9, 5e9]).withColumn("z", r6("z"))


@query("""WITH s AS (SELECT p_partkey, greatest(100, ceil(1e17 / (6 * (12.0 * p_size * (64 * p_size) * 64)) / 8192))::BIGINT AS steps FROM part)
SELECT p_partkey, steps, least(100, greatest(10, steps // 20))::BIGINT AS warmup, greatest(25, steps // 20)::BIGINT AS "interval" FROM s""")
def training_steps(spark, sf):
    size = F.col("p_size").cast("double")
    return table(spark, sf, "part").select("p_partkey", L.training_steps(F.lit(1e17), 12 * size * 64 * size * 64).alias("s")).select("p_partkey", "s.*")


@query("""SELECT event_id, round(CASE WHEN event_id < 100 THEN 0.002 * event_id / 100 WHEN event_id > 800 THEN 0.0002 ELSE 0.0002 + 0.5 * (1 + cos(pi() * (event_id - 100) / 700)) * (0.002 - 0.0002) END, 9) AS rate FROM events""")
def cosine_schedule(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(L.cosine_rate(F.col("event_id"), 0.002, 0.0002, 100, 800), 9).alias("rate"))


@query(f"""WITH {_RUNS}, e AS (SELECT 6 * parameters * tokens AS compute, loss - ln(parameters) / 10 AS residual FROM r), a AS (SELECT stddev_pop(residual) AS s, corr(ln(compute), residual) AS c FROM e)
SELECT compute, round(avg(residual), 6) AS bias, abs(avg(residual)) > 3 * any_value(s) AS biased, round(any_value(c), 6) AS correlation, any_value(c) > 0.5 AS rising FROM e, a GROUP BY 1""")
def extrapolation_report(spark, sf):
    e = _runs(spark, sf).select((6 * F.col("parameters") * F.col("tokens")).alias("compute"), (F.col("loss") - F.log("parameters") / 10).alias("residual"))
    return L.extrapolation_report(e).withColumn("bias", r6("bias")).withColumn("correlation", r6("correlation"))


@query()
def joint_law_fit(spark, sf):
    return L.joint_law_fit(_runs(spark, sf).where("status = 'completed'"))


@query()
def robust_power_law(spark, sf):
    return L.robust_power_law(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", rounds=20).select(r6("coefficient").alias("coefficient"), r6("exponent").alias("exponent"))


# --- preferences ----------------------------------------------------------------------
@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS p, list_transform(embedding[17:32], lambda x: x::DOUBLE) AS o, (vec_id % 5 - 2)::DOUBLE AS adv FROM embeddings),
t AS (SELECT vec_id, adv, unnest(list_transform(range(1, 17), lambda i: exp(p[i] - o[i]))) AS r FROM v)
SELECT vec_id, round(avg(-least(adv * r, adv * least(1.2, greatest(0.8, r)))), 6) AS loss, round(avg((r < 0.8 OR r > 1.2)::INT::DOUBLE), 6) AS clipped FROM t GROUP BY 1""")
def clipped_objective(spark, sf):
    part = lambda a: F.transform(F.slice("embedding", a, 16), lambda x: x.cast("double"))
    e = table(spark, sf, "embeddings").select("vec_id", P.clipped_objective((F.col("vec_id") % 5 - 2).cast("double"), part(1), part(17)).alias("c"))
    mean = F.aggregate("c.loss", F.lit(0.0), lambda s, x: s + x) / F.size("c.loss")
    return e.select("vec_id", r6(mean).alias("loss"), r6(F.col("c.clip_fraction")).alias("clipped"))


@query("""WITH z AS (SELECT vec_id, embedding[1]::DOUBLE - embedding[3]::DOUBLE AS g, embedding[2]::DOUBLE - embedding[4]::DOUBLE AS b FROM embeddings)
SELECT vec_id, round(greatest(-0.1 * (g - b), 0) + ln(1 + exp(-abs(0.1 * (g - b)))), 6) AS loss, 0.1 * (g - b) > 0 AS "right", round(g, 6) AS chosen_reward, round(b, 6) AS rejected_reward FROM z""")
def preference_loss(spark, sf):
    x = [F.col("embedding")[i].cast("double") for i in range(4)]
    e = table(spark, sf, "embeddings").select("vec_id", P.preference_loss(*x).alias("p")).select("vec_id", "p.*")
    return e.select("vec_id", "right", *[r6(c).alias(c) for c in ("loss", "chosen_reward", "rejected_reward")])


@query()
def bradley_terry(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 20).alias("a"), ((F.col("user_id") + F.col("event_id")) % 20).alias("b"), (F.col("value") > 50).cast("double").alias("score"))
    return P.bradley_terry(e).withColumn("strength", r6("strength"))


@query("""WITH s AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY o, event_type)::INT AS rank, event_type FROM s QUALIFY rank <= 2""")
def first_distinct_answers(spark, sf):
    return P.first_distinct_answers(table(spark, sf, "events"), "user_id", "event_type", "event_id", 2)


@query("""WITH s AS (SELECT source, 0.05::DOUBLE AS weight, sum(n_chars)::BIGINT AS tokens, substr(md5(source), 1, 1) < '8' AS syn FROM documents GROUP BY 1),
p AS (SELECT source, syn, least(trunc(4e6::DOUBLE * weight)::BIGINT, tokens) AS n, 4e6::DOUBLE * weight / greatest(tokens, 1) AS epochs FROM s), m AS (SELECT coalesce(sum(n) FILTER (syn), 0) AS made FROM p)
SELECT source, CASE WHEN syn AND made > 400000 THEN trunc(n * (400000::DOUBLE / made))::BIGINT ELSE n END AS sampled, round(epochs, 6) AS epochs FROM p, m""")
def mixture_plan(spark, sf):
    s = table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("tokens")).withColumn("weight", F.lit(0.05)).withColumn("synthetic", F.substring(F.md5("source"), 1, 1) < "8")
    return P.mixture_plan(s, 4_000_000, 0.1).withColumn("epochs", r6("epochs"))


# --- runs and streams of tokens -------------------------------------------------------
@query("""SELECT user_id, event_id, round((value - lag(value) OVER w) / greatest((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 1e-9), 6) + 0::DOUBLE AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def throughput_deltas(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "value", F.unix_micros(F.to_timestamp("ts")).alias("us"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.greatest((F.col("us") - F.lag("us").over(w)) / 1e6, F.when(F.lag("us").over(w).isNotNull(), 1e-9))
    return e.select("user_id", "event_id", (r6((F.col("value") - F.lag("value").over(w)) / seconds) + 0.0).alias("rate"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, arg_min(event_id, (value, event_id)) AS best, max(value) AS most, round(median(value) FILTER (k > 1), 6) AS typical FROM n GROUP BY 1""")
def best_and_typical(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("k", F.row_number().over(w))
    return e.groupBy("user_id").agg(
        F.min_by("event_id", F.struct("value", "event_id")).alias("best"), F.max("value").alias("most"), r6(F.median(F.when(F.col("k") > 1, F.col("value")))).alias("typical")
    )


@query("""SELECT l_returnflag, round(avg(l_extendedprice) FILTER (l_linestatus = 'F'), 4) AS f, round(avg(l_extendedprice) FILTER (l_linestatus = 'O'), 4) AS o,
round(avg(l_extendedprice) FILTER (l_linestatus = 'F') / avg(l_extendedprice) FILTER (l_linestatus = 'O'), 6) AS ratio FROM lineitem GROUP BY 1""")
def variant_ratios(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_extendedprice"))
    return p.select("l_returnflag", F.round("F", 4).alias("f"), F.round("O", 4).alias("o"), r6(F.col("F") / F.col("O")).alias("ratio"))


@query("""SELECT lang, count(*) AS n, round(sum(strlen(text))::DOUBLE / sum(len(string_split(text, ' '))), 6) AS bytes_per_token, round(sum(length(text) * 0.7::DOUBLE) / sum(strlen(text)), 6) AS nats_per_byte,
round(sum(length(text) * 0.7::DOUBLE) / sum(strlen(text)) / ln(2::DOUBLE), 6) AS bits_per_byte FROM documents GROUP BY 1""")
def bits_per_byte(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.octet_length("text").alias("b"), F.size(F.split("text", " ")).alias("t"), (F.length("text") * 0.7).alias("nats"))
    per = F.sum("nats") / F.sum("b")
    return d.groupBy("lang").agg(F.count("*").alias("n"), r6(F.sum("b") / F.sum("t")).alias("bytes_per_token"), r6(per).alias("nats_per_byte"), r6(per / F.log(F.lit(2.0))).alias("bits_per_byte"))


@query("""WITH o AS (SELECT doc_id, n_chars, (coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM documents), t AS (SELECT ceil(sum(n_chars) * 0.9 / 4096)::BIGINT * 4096 AS train FROM documents)
SELECT doc_id, CASE WHEN start + n_chars <= train THEN 'train' WHEN start >= train THEN 'validation' ELSE 'both' END AS split FROM o, t""")
def token_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    train = d.agg((F.ceil(F.sum("n_chars") * F.lit("0.9").cast("decimal(2,1)") / 4096) * 4096).cast("long").alias("train"))
    split = F.when(F.col("start") + F.col("n_chars") <= F.col("train"), "train").when(F.col("start") >= F.col("train"), "validation").otherwise("both")
    return Q.offsets(d, "doc_id", "n_chars").crossJoin(F.broadcast(train)).select("doc_id", split.alias("split"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents")
def fixed_batches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").withColumn("one", F.lit(1))
    return Q.offsets(d, "doc_id", "one").select("doc_id", F.floor(F.col("start") / 16).alias("batch"))


@query("""SELECT c_custkey, sha256('{"acctbal":' || round(c_acctbal)::BIGINT || ',"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}') AS hash FROM customer""")
def stable_hashes(spark, sf):
    typed = F.to_json(F.struct(F.round("c_acctbal").cast("long").alias("acctbal"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")))
    return table(spark, sf, "customer").select("c_custkey", F.sha2(typed, 256).alias("hash"))


@query("""SELECT l_returnflag, arg_min(l_orderkey * 10 + l_linenumber, (abs(l_discount - 0.052), l_orderkey * 10 + l_linenumber)) AS run FROM lineitem GROUP BY 1""")
def nearest_to_target(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("run", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return l.groupBy("l_returnflag").agg(F.min_by("run", F.struct(F.abs(F.col("l_discount") - 0.052), "run")).alias("run"))
