"""Secret scans with multipart credential linking.

Strong secrets (assignments, access identifiers, long hex strings) are reported
wherever they stand. Weak parts - bare key-like strings and endpoints - are only
reported when complementary parts stand in the same scope: the parts of a text are
joined with the intervals of its scopes: ``BLOCK_LINES`` lines either way, blank ones
counted, as long as a section of a credentials file. Everything is a row's own array expression: no shuffle, no Python,
and linear work in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._expr import let, running_max, running_sums

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KEYLIKE = r"[A-Za-z0-9+/]+"
ENDPOINT = r"https?://[A-Za-z0-9._~:/?#@!&=%+-]+"
KINDS = ("assign", "access", "hex", "bare_key", "endpoint")
BARE_KEY_LENGTH = 40
BLOCK_LINES = 20


def _spans(text: Column, pattern: str, least: Column | None = None, group: int = 0, rank: int = 0) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches, in code points, end exclusive.

    The texts between matches and the matches themselves give the positions as running
    sums. ``least(match, group)`` drops matches after the matching.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def placed(ms: Column) -> Column:
        sizes = F.zip_with(F.slice(between, F.lit(1), F.size(ms)), ms, lambda a, b: (F.length(a) + F.length(b)).cast("long"))
        inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else ms
        return let(
            running_sums(sizes),
            lambda ends: let(
                F.zip_with(F.zip_with(ms, ends, lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m"))), inner,
                           lambda x, g: F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), x["m"].alias("m"), g.alias("g"))),
                lambda xs: F.transform(
                    F.filter(xs, lambda x: least(x["m"], x["g"])) if least else xs,
                    lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")),
                ),
            ),
        )

    return let(found, placed)


NO_SPANS = "array<struct<s:bigint,k:int,e:bigint>>"


def _if(seen: Column, spans: Column) -> Column:
    return F.when(seen, spans).otherwise(F.array().cast(NO_SPANS))


def base_spans(text: Column) -> Column:
    """Spans ``(s, k, e)`` of the strong kinds, sorted by start, then kind."""
    # A short first test spares most texts the three passes that positions need.
    return F.array_sort(
        F.concat(
            _if(text.rlike(ASSIGN), _spans(text, ASSIGN, lambda m, g: F.length(g) >= 6, group=2, rank=0)),
            _if(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, lambda m, g: F.length(m) >= 20, rank=1)),
            _if(text.rlike(r"[0-9a-f]{24}"), _spans(text, HEX, lambda m, g: F.length(m) >= 24, rank=2)),
        )
    )


def _is_bare_key(m: Column) -> Column:
    return (F.length(m) == BARE_KEY_LENGTH) & m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")


def _line_parts(text: Column) -> Column:
    """Per line: length, weak spans within the line, and which strong parts it holds."""

    def located(line: Column) -> Column:
        return F.struct(
            F.length(line).cast("long").alias("n"),
            _if(line.rlike(r"[A-Za-z0-9+/]{40}"), _spans(line, KEYLIKE, lambda m, g: _is_bare_key(m), rank=3)).alias("keys"),
            _if(F.contains(line, F.lit("://")), _spans(line, ENDPOINT, rank=4)).alias("ends"),
            line.rlike(r"AKIA[A-Z0-9]{16}").alias("access"),
            F.exists(F.regexp_extract_all(line, F.lit(ASSIGN), F.lit(2)), lambda g: F.length(g) >= 6).alias("assign"),
        )

    return F.transform(F.split(text, "\n"), located)


def linked_spans(parts: Column, line_ends: Column, scope_lines: int = BLOCK_LINES) -> Column:
    """Spans of the weak kinds whose complements stand in the same scope.

    A bare key counts where an access identifier or an endpoint stands at most
    ``scope_lines`` lines away; an endpoint counts where both an access identifier and a
    secret (a bare key or an assignment) do.
    """

    def near(i: Column, test) -> Column:
        begin = F.greatest(i - scope_lines, F.lit(0))
        return F.exists(F.slice(parts, begin + 1, i + scope_lines + 1 - begin), test)

    def report(p: Column, i: Column) -> Column:
        begin = F.get(line_ends, i) - p["n"] - 1
        access = near(i, lambda x: x["access"])
        key_ok = access | near(i, lambda x: F.size(x["ends"]) > 0)
        end_ok = access & near(i, lambda x: (F.size(x["keys"]) > 0) | x["assign"])
        both = F.concat(_if((F.size(p["keys"]) > 0) & key_ok, p["keys"]), _if((F.size(p["ends"]) > 0) & end_ok, p["ends"]))
        return F.transform(both, lambda x: F.struct((x["s"] + begin).alias("s"), x["k"].alias("k"), (x["e"] + begin).alias("e")))

    return F.flatten(F.transform(parts, report))


def _worth_linking(text: Column, strong: Column) -> Column:
    has_key = text.rlike(r"[A-Za-z0-9+/]{40}")
    has_end = F.contains(text, F.lit("://"))
    has_access = F.exists(strong, lambda x: x["k"] == 1)
    return (has_key & (has_access | has_end)) | (has_end & has_access)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def scan_secrets(docs: DataFrame, text_col: str = "text", scope_lines: int = BLOCK_LINES) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``, arrays of (s, k, e) sorted by start, then kind.

    Parts are linked over ``scope_lines`` lines either way. Null and empty texts have no
    spans. Rows are judged alone, so repeated rows, null ids and extra columns change
    nothing; an empty table gives an empty result. An existing column of either name is
    replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("base_spans", base_spans(text))

    def weak(parts: Column) -> Column:
        ends = running_sums(F.transform(parts, lambda p: p["n"] + 1))
        return let(ends, lambda line_ends: linked_spans(parts, line_ends, scope_lines))

    lines = F.when(_worth_linking(text, F.col("base_spans")), _line_parts(text))
    return out.withColumn("all_spans", F.coalesce(F.array_sort(F.concat("base_spans", let(lines, weak))), F.col("base_spans")))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of each strong kind, a digest of the strong spans, and all spans."""
    scanned = scan_secrets(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")), "_t")
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["k"] == k)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"), _written(F.col("all_spans")).alias("spans"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", scope_lines: int = BLOCK_LINES) -> DataFrame:
    """``docs`` with each secret span of ``text_col`` replaced by ``mark``.

    Weak parts are linked over ``scope_lines`` lines either way. Overlapping spans are
    replaced together, once. A null text stays null; all other columns stay as they are,
    whatever their names.
    """

    def cut(text: Column, spans: Column) -> Column:
        # a span's fresh part starts after all earlier ends; nothing is left of a covered span
        def masked(xs: Column) -> Column:
            def part(x: Column, i: Column) -> Column:
                prior = F.when(i == 0, F.lit(0)).otherwise(F.get(xs, i - 1)["e"])
                clean = F.when(x["s"] >= prior, F.concat(F.substring(text, (prior + 1).cast("int"), (x["s"] - prior).cast("int")), F.lit(mark)))
                return F.coalesce(clean, F.lit(""))

            tail = F.substring(text, (F.get(xs, F.size(xs) - 1)["e"] + 1).cast("int"), F.length(text))
            return F.concat(F.array_join(F.transform(xs, part), ""), tail)

        ends = F.zip_with(spans, running_max(F.transform(spans, lambda x: x["e"])), lambda x, e: F.struct(x["s"].alias("s"), e.alias("e")))
        return F.when(F.size(spans) == 0, text).otherwise(let(ends, masked))

    scanned = scan_secrets(docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_t")), "_t", scope_lines)
    return scanned.select(*[cut(F.col("_t"), F.col("all_spans")).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


def _sql_spans(name: str, text: str, pattern: str, keep: str, group: int = 0, key: str = "rid") -> str:
    """DuckDB: the spans of one pattern for each row of ``src``."""
    return f"""
    {name}_raw AS (SELECT {key}, regexp_extract_all({text}, {pattern}) AS ms, regexp_extract_all({text}, {pattern}, {group}) AS gs,
        string_split_regex({text}, {pattern}) AS ps FROM src WHERE regexp_matches({text}, {pattern})),
    {name}_pos AS (SELECT {key}, unnest(ms) AS m, unnest(gs) AS g, unnest(range(1, len(ms) + 1)) AS i,
        unnest(list_transform(range(1, len(ms) + 1), lambda j: list_sum(list_transform(ps[:j], lambda p: length(p)))::BIGINT)) AS before,
        unnest(list_transform(range(1, len(ms) + 1), lambda j: list_sum(list_transform(ms[:j], lambda p: length(p)))::BIGINT)) AS matched FROM {name}_raw),
    {name} AS (SELECT {key}, before + matched - length(m) AS s, before + matched AS e, m FROM {name}_pos WHERE {keep})"""


_A = """'([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)'"""

ORACLE_SQL = f"""
WITH src AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{_sql_spans("assign", "t", _A, "length(g) >= 6", 2)},
{_sql_spans("access", "t", "'AKIA[A-Z0-9]+'", "length(m) >= 20")},
{_sql_spans("hexes", "t", "'[0-9a-f]{24,}'", "true")},
{_sql_spans("keys", "t", "'[A-Za-z0-9+/]{40,}'", "length(m) = 40 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')")},
{_sql_spans("ends", "t", "'https?://[A-Za-z0-9._~:/?#@!&=%+-]+'", "true")},
parts AS (SELECT rid, 0 AS k, s, e FROM assign UNION ALL SELECT rid, 1, s, e FROM access UNION ALL SELECT rid, 2, s, e FROM hexes
    UNION ALL SELECT rid, 3, s, e FROM keys UNION ALL SELECT rid, 4, s, e FROM ends),
lined AS (SELECT p.*, length(substr(src.t, 1, s)) - length(replace(substr(src.t, 1, s), chr(10), '')) AS ln FROM parts p JOIN src USING (rid)),
shown AS (SELECT rid, k, s, e FROM lined w WHERE k < 3
    OR k = 3 AND EXISTS (SELECT 1 FROM lined c WHERE c.rid = w.rid AND abs(c.ln - w.ln) <= {BLOCK_LINES} AND c.k IN (1, 4))
    OR k = 4 AND EXISTS (SELECT 1 FROM lined c WHERE c.rid = w.rid AND abs(c.ln - w.ln) <= {BLOCK_LINES} AND c.k = 1)
             AND EXISTS (SELECT 1 FROM lined c WHERE c.rid = w.rid AND abs(c.ln - w.ln) <= {BLOCK_LINES} AND c.k IN (0, 3))),
told AS (SELECT rid, string_agg(n || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans,
    string_agg(n || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
    count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c
    FROM (SELECT *, ['assign', 'access', 'hex', 'bare_key', 'endpoint'][k + 1] AS n FROM shown) GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM src LEFT JOIN told USING (rid)
"""
