"""Sinks: texts and token files, shards, summaries, logs, tokenizer artifacts, archives.

Files that are not Spark's own are written by tasks through Arrow's file systems, each
under a name that its task's input decides, so a task that runs twice writes the same.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder_uri(spark: SparkSession, folder: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return re.sub(r"^file:/+", "file:///", at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString())


def _store(uri: str, name: str, data: bytes) -> None:
    fs, base = pafs.FileSystem.from_uri(uri)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
        f.write(data)


def write_texts(docs: DataFrame, folder: str, name_col: str, text_col: str = "text") -> DataFrame:
    """A file for each row, named by the last part of ``name_col``; empty texts are written too. ``(name, n_bytes)``.

    Two rows of one name are an error, found before anything is written."""
    uri = folder_uri(docs.sparkSession, folder)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, text in part.itertuples(index=False):
                data = (text or "").encode()
                _store(uri, name, data)
                out.append((name, len(data)))
            yield pd.DataFrame(out, columns=["name", "n_bytes"])

    named = docs.select(F.element_at(F.split(F.col(name_col).cast("string"), "/"), -1).alias("name"), F.col(text_col).alias("text"))
    twice = named.groupBy("name").count().where("count > 1").orderBy("name").first()
    if twice is not None:
        raise ValueError(f"{twice['count']} rows are to be written to {twice['name']}")
    return named.mapInPandas(run, "name string, n_bytes long")


def write_survivors(docs: DataFrame, losers: DataFrame, keys: list[str], path: str) -> None:
    """``docs`` without the rows whose keys are among the losers."""
    docs.join(losers.select(*keys), keys, "left_anti").write.mode("overwrite").parquet(path)


def write_token_files(docs: DataFrame, folder: str, eos: int, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Token files of little-endian 16-bit numbers, one a partition, ``eos`` after each document.

    ``(name, docs, tokens, bytes, text_bytes, least, most)`` a file; an id over 16 bits is an error."""
    uri = folder_uri(docs.sparkSession, folder)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        name = f"tokens-{TaskContext.get().partitionId():05d}.bin"
        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        n, total, text_bytes, least, most, out = 0, 0, 0, 0xFFFF, 0, None
        try:
            for part in parts:  # a batch is written before the next is read
                for ids, size in part.itertuples(index=False):
                    a = np.append(np.asarray([] if ids is None else ids, dtype=np.int64), eos)
                    least, most = min(least, int(a.min())), max(most, int(a.max()))
                    if a.min() < 0 or most > 0xFFFF:
                        raise ValueError("a token id does not fit 16 bits")
                    out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(a.astype("<u2").tobytes())
                    n, total, text_bytes = n + 1, total + len(a), text_bytes + size
        finally:
            if out is not None:
                out.close()
        if n:
            yield pd.DataFrame([(name, n, total, 2 * total, text_bytes, least, most)], columns=["name", "docs", "tokens", "bytes", "text_bytes", "least", "most"])

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    return docs.select(ids_col, size.alias("_n")).mapInPandas(run, "name string, docs long, tokens long, bytes long, text_bytes long, least long, most long")


def encode_metrics(files: DataFrame, seconds: float) -> DataFrame:
    """One row over the files of ``write_token_files``: totals, tokens a second, text bytes a token, least and largest id."""
    return files.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.sum("text_bytes").alias("text_bytes"), F.min("least").alias("least"), F.max("most").alias("most")).select(
        "*", (F.col("tokens") / F.lit(float(seconds))).alias("tokens_per_second"), (F.col("text_bytes") / F.col("tokens")).alias("bytes_per_token")
    )


def write_token_shards(pieces: DataFrame, folder: str) -> None:
    """Rows ``(split, shard, ...)`` as ``split=.../shard=000007``, numbers padded so that names sort."""
    named = pieces.withColumn("shard", F.lpad(F.col("shard").cast("string"), 6, "0"))
    named.repartition("split", "shard").write.mode("overwrite").partitionBy("split", "shard").parquet(folder)


def write_summary(summary: DataFrame, path: str) -> None:
    """A few aggregated rows as JSON, nulls kept."""
    summary.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def best_so_far(spark: SparkSession, path: str, schema: str, by: str, step: str = "step") -> DataFrame:
    """What a resumed run needs of its log: the last step and the best record, ties to the earlier step."""
    log = spark.read.schema(schema).json(path)
    return log.agg(F.max(step).alias("last_step"), F.min_by(F.struct("*"), F.struct(by, step)).alias("best"))


def byte_letters() -> dict[int, str]:
    """A printable character for each byte: itself where it prints, else one from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def save_tokenizer(spark: SparkSession, vocab: dict[int, bytes], merges: list[tuple[bytes, bytes]], folder: str) -> None:
    """Vocabulary and merges as two JSON tables, each token in hexadecimal and in letters."""
    to = byte_letters()
    said = lambda x: "".join(to[b] for b in x)
    write_summary(spark.createDataFrame([(i, t.hex(), said(t)) for i, t in vocab.items()], "id int, hex string, letters string"), f"{folder}/vocab")
    rows = [(i, a.hex(), b.hex(), f"{said(a)} {said(b)}") for i, (a, b) in enumerate(merges)]
    write_summary(spark.createDataFrame(rows, "rank int, left_hex string, right_hex string, letters string"), f"{folder}/merges")


def load_tokenizer(spark: SparkSession, folder: str) -> tuple[dict[int, bytes], list[tuple[bytes, bytes]]]:
    vocab = spark.read.schema("id int, hex string").json(f"{folder}/vocab").collect()  # a vocabulary fits the driver
    merges = spark.read.schema("rank int, left_hex string, right_hex string").json(f"{folder}/merges").orderBy("rank").collect()
    return {r.id: bytes.fromhex(r.hex) for r in vocab}, [(bytes.fromhex(r.left_hex), bytes.fromhex(r.right_hex)) for r in merges]


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Rows ``(rec_type, url, payload)`` as compressed archives, one a partition and a member a record, each written as it
    comes. ``(name, records, bytes)``."""
    uri = folder_uri(records.sparkSession, folder)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        name, n, size, out = f"part-{TaskContext.get().partitionId():05d}.warc.gz", 0, 0, None
        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        try:
            for part in parts:
                for kind, url, payload in part.itertuples(index=False):
                    body = bytes(payload or b"")
                    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url or ''}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                    out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                    frame = gzip.compress(head + body + b"\r\n\r\n", mtime=0)
                    out.write(frame)
                    n, size = n + 1, size + len(frame)
        finally:
            if out is not None:
                out.close()
        if n:
            yield pd.DataFrame([(name, n, size)], columns=["name", "records", "bytes"])

    return records.select("rec_type", "url", "payload").mapInPandas(run, "name string, records long, bytes long")


def rewrite_archives(spark: SparkSession, path: str, folder: str, keep, glob: str = "*.warc*.gz") -> DataFrame:
    """Each compressed archive below ``path`` again in ``folder``, without the conversion records that
    ``keep(text)`` turns down; all other records go over as they are. ``(name, records, kept)``.

    An archive is one task's, which reads and writes a record at a time. Two archives of one name are an error."""
    from millrace.sources.splits import listed
    from millrace.sources.web import raw_records

    uri, source = folder_uri(spark, folder), folder_uri(spark, path)
    paths = [x for x, _, _ in listed(source, glob)]
    names = [x.rsplit("/", 1)[-1] for x in paths]
    if len(set(names)) < len(names):
        raise ValueError("archives of one name would overwrite each other")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, _ = pafs.FileSystem.from_uri(source)
        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        for part in parts:
            done = []
            for path_ in part["path"]:
                name, n, kept = path_.rsplit("/", 1)[-1], 0, 0
                with own.open_input_file(path_) as f, fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                    for kind, raw, payload in raw_records(io.BufferedReader(gzip.GzipFile(fileobj=f))):
                        n += 1
                        if kind != "conversion" or keep(payload.decode("utf-8", "replace")):
                            out.write(gzip.compress(raw, mtime=0))
                            kept += 1
                done.append((name, n, kept))
            yield pd.DataFrame(done, columns=["name", "records", "kept"])

    files = spark.createDataFrame([(x,) for x in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInPandas(run, "name string, records long, kept long")
