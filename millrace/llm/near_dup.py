"""Near duplicates of texts: links of their shingle sets, by ``operators/set_links.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.set_links import MISS, grouped_rows, match_thresholds, spanning_links  # noqa: F401
from millrace.plans.scratch import Scratch


def near_duplicates(
    docs: DataFrame, k: int = 5, inner: int = 80, union: int = 100, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``.

    Texts are linked where ``union * |A and B| >= inner * |A or B|`` for their sets of
    ``k``-word shingles; ``component_id`` is the least id that links lead to, ``kept`` is
    true for that id. Texts without words, null or empty, are linked with nothing. Rows
    that repeat an id are grouped by their own texts; a row with a null id keeps a null
    component and is kept. Other columns are ignored, and an empty table gives an empty
    result. A pair at exactly the threshold is missed with probability ``miss`` at each of
    two tests; the lower it is, and the lower the threshold, the more pairs are compared.
    """
    found = grouped_rows(docs, k, inner, union, miss, id_col, text_col)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: one with the least id.

    Rows without words and rows with a null id all stay. Rows that repeat an id are rows of
    their own: they stay unless their texts are near duplicates. Columns of any name pass.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    found = grouped_rows(docs, k, 80, 100, MISS, id_col, text_col).where("comp is not null and id = component_id")
    heads = found.groupBy("comp", "id", "t").agg(F.count("*").alias("m")).groupBy("comp").agg(F.min(F.struct("id", "t", "m")).alias("x"))
    heads = scratch.save(heads.select("x.*"), "heads")
    loose = F.col(id_col).isNull() | ~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), loose.alias("_loose"))
    named = named.join(heads, ["id", "t"], "left").where("_loose or m is not null")
    if heads.where("m > 1").isEmpty():
        return named.select("_row.*")
    alone = F.col("_loose") | (F.col("m") == 1)
    return named.where(alone).select("_row.*").unionByName(named.where(~alone).dropDuplicates(["id", "t"]).select("_row.*"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_hash) AS rep FROM (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS list_hash FROM s GROUP BY doc_id)),
r AS (SELECT s.doc_id, g FROM s JOIN same USING (doc_id) WHERE doc_id = rep),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM r x JOIN r y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
near AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM near UNION SELECT b, a FROM near UNION SELECT doc_id, rep FROM same WHERE doc_id <> rep UNION SELECT rep, doc_id FROM same WHERE doc_id <> rep),
reach AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.v AND reach.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM reach GROUP BY v) m ON m.v = d.doc_id
"""
