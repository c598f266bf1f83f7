"""Plain file sources: texts, JSON, CSV, listings, run folders; models and artifacts by name."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.scratch import shared_dir


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)``, a row a file, decompressed by suffix; line ends become ``\\n``."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.input_file_name().alias("path"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))


def read_json(spark: SparkSession, path: str, schema: str, array: bool = False) -> DataFrame:
    """Records of JSON lines, or of files that are one array each. Blank lines are none; a broken record fails the read."""
    return spark.read.schema(schema).option("multiLine", array).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)


def read_strict_csv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """Text columns, stripped. Every file's first line must be exactly ``header``."""
    want = ",".join(header)
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"^(?:\x{FEFF})?([^\r\n]*)", 1).alias("first"))
    if not lines.where(F.col("first") != want).isEmpty():
        raise ValueError(f"the header is not {want}")
    raw = spark.read.schema(", ".join(f"`{h}` string" for h in header)).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").csv(path)
    return raw.select(*[F.trim(F.col(f"`{h}`")).alias(h) for h in header])


def hashed(*columns: Column) -> Column:
    """A long that any engine computes: 48 bits of the MD5 of the columns, joined by dashes."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *columns)), 1, 12), 16, 10).cast("long")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, those with the least hash of key and seed: a top-k, not a sort."""
    return df.orderBy(hashed(F.col(key).cast("string"), F.lit(seed)), key).limit(n)


def read_path_list(spark: SparkSession, path: str, n: int | None = None, seed: int = 0) -> DataFrame:
    """``(path)`` of a list without a header, compressed or not; a seeded sample if ``n`` is given."""
    found = spark.read.schema("path string").csv(path).select(F.trim("path").alias("path")).where("path <> ''")
    return found if n is None else seeded_sample(found, "path", n, seed)


def listing_names(html: Column, pattern: str) -> Column:
    """Distinct names that a directory page links to, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(f'href="({pattern})"'), F.lit(1))))


def shuffled_listing(files: DataFrame, suffix: str = ".parquet", seed: int = 0, path_col: str = "path") -> DataFrame:
    """Files of a suffix in seeded order."""
    return files.where(F.col(path_col).endswith(suffix)).orderBy(hashed(F.col(path_col), F.lit(seed)), path_col)


def discover_runs(spark: SparkSession, root: str, schema: str, name: str = "metrics.jsonl", pattern: str = r"c([0-9]e[+-][0-9]+)-([^/]+)/[^/]*$") -> DataFrame:
    """Records of every file ``name`` below ``root``, with ``run`` (its folder), and ``budget`` and
    ``label`` as the pattern's groups read them off the path; empty where it does not match."""
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(root)
    path = F.input_file_name()
    return found.select(
        "*", F.regexp_extract(path, r"([^/]+)/[^/]*$", 1).alias("run"), F.regexp_extract(path, pattern, 1).alias("budget"), F.regexp_extract(path, pattern, 2).alias("label")
    )


def first_path(candidates: tuple[str, ...]) -> str | None:
    """The first candidate that is a file here; null if none is."""
    return next((p for p in candidates if p and os.path.isfile(p)), None)


@cache
def loaded(load: Callable[[str], Callable], candidates: tuple[str, ...]):
    """The model at the first candidate path, loaded once a worker; null if there is none."""
    path = first_path(candidates)
    return None if path is None else load(path)


def predicted(load: Callable[[str], Callable], candidates: tuple[str, ...], text: Column, fallback: Column) -> Column:
    """Struct label, score of a model ``text -> (label, score) or None``; ``fallback`` where there is no
    model, no prediction or only white space. Line feeds reach the model as blanks."""

    @F.pandas_udf(T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]))
    def run(texts: pd.Series) -> pd.DataFrame:
        model = loaded(load, candidates)
        rows = [None if model is None or t is None or not t.strip() else model(t.replace("\n", " ")) for t in texts]
        return pd.DataFrame([(None, None) if r is None else r for r in rows], columns=["label", "score"])

    got = run(text)
    return F.when(got["label"].isNotNull(), got).otherwise(fallback)


def plain_label(label: Column) -> Column:
    """A model's label in one spelling: without its prefix, in lower case, underscores as dashes."""
    return F.replace(F.lower(F.regexp_replace(label, "^__label__", "")), F.lit("_"), F.lit("-"))


# Labels that count as a hit, by kind, and the names of the two outcomes.
POSITIVE = {"nsfw": ("nsfw", "obscene", "porn", "pornographic", "1"), "toxic": ("toxic", "hatespeech", "hate-speech", "hate", "1")}


def safety_outcome(kind: str, label: Column) -> Column:
    return F.when(plain_label(label).isin(*POSITIVE[kind]), kind).otherwise(f"non-{kind}")


# Names of the two sides of a quality model.
QUALITY_SIDES = {"wiki": ("wiki", "high", "high-quality"), "cc": ("cc", "low", "low-quality")}


def quality_side(label: Column) -> Column:
    """``wiki`` or ``cc`` from a model's label or one of its aliases; any other label is an error, null stays null."""
    plain = plain_label(label)
    out = F.when(plain.isNull(), F.lit(None).cast("string"))
    for side, names in QUALITY_SIDES.items():
        out = out.when(plain.isin(*names), side)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown quality label: "), label)).cast("string"))


def stable_hash(**columns: Column) -> Column:
    """SHA-256 of the named values as JSON, names sorted, so that the order they are given in does not matter."""
    return F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def artifact_key(params: dict) -> str:
    return hashlib.blake2s(json.dumps(params, sort_keys=True, default=str).encode(), digest_size=10).hexdigest()


def load_or_create(spark: SparkSession, kind: str, params: dict, create: Callable[[], DataFrame]) -> DataFrame:
    """The table that these parameters gave before, from the shared folder; else made and kept there.

    A table counts only if its write was completed, so a lost job leaves nothing behind."""
    path = f"{shared_dir(spark)}/artifacts/{kind}-{artifact_key(params)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        create().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
