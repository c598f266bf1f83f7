"""Registry checks: host lists, links, gaps in numbering, required sections, paired filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.functions.text import url_host

LINK = r"\[[^\]]*\]\(([^)\s]+)\)"


def host_suffixes(host: Column) -> Column:
    """The host and each domain above it: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def listed_hosts(pages: DataFrame, entries: DataFrame, id_col: str, url_col: str = "url") -> DataFrame:
    """``(id, listed)``: whether the page's host, or a domain above it, is an entry ``(domain)``.
    An equi-join of suffixes; a page without a host is not listed."""
    suffixes = pages.select(id_col, F.explode(host_suffixes(url_host(F.col(url_col)))).alias("domain"))
    hit = suffixes.join(entries.select("domain").where("domain <> ''"), "domain", "left_semi").select(id_col).distinct().withColumn("listed", F.lit(True))
    return pages.select(id_col).join(hit, id_col, "left").select(id_col, F.coalesce("listed", F.lit(False)).alias("listed"))


def broken_links(pages: DataFrame, held: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, target)`` of relative Markdown links whose file is not among ``held`` (path)."""
    found = pages.select(id_col, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LINK), F.lit(1))).alias("target"))
    links = found.withColumn("target", F.regexp_replace("target", "#.*$", "")).where("target <> '' and not target rlike '^(https?:|mailto:)'").distinct()
    return links.join(held.select(F.col("path").alias("target")), "target", "left_anti").select(id_col, "target")


def numbering_gaps(df: DataFrame, key: str, number: str) -> DataFrame:
    """``(key, first, last)``: ranges of whole numbers missing between a key's least and largest."""
    ahead = F.lead(number).over(Window.partitionBy(key).orderBy(number))
    runs = df.select(key, number).distinct().withColumn("_next", ahead).where(F.col("_next") > F.col(number) + 1)
    return runs.select(key, (F.col(number) + 1).alias("first"), (F.col("_next") - 1).alias("last"))


def missing_sections(text: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Names of the groups none of whose headings occurs in the text."""
    have = {name: F.lit(False) if not any_ else F.greatest(*[F.contains(text, F.lit(x)) for x in any_], F.lit(False)) for name, any_ in groups.items()}
    return F.filter(F.array(*[F.when(~F.coalesce(h, F.lit(False)), F.lit(n)) for n, h in have.items()]), lambda x: x.isNotNull())


def in_both(df: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Rows each of whose ``columns`` has its value somewhere in the other table's column; not as a tuple."""
    for c in columns:
        df = df.join(other.select(c).where(F.col(c).isNotNull()), c, "left_semi")
    return df
