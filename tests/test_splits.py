"""Archives and token files in ranges: each record and token once, whatever the ranges."""

import gzip
import os
import random

import numpy as np
import pytest

from millrace.sources import sinks
from millrace.sources.splits import Range, delimited_chunks, members, read_archives, read_tokens
from millrace.streaming.events import drain


def warc(i, payload):
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/{i}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(3)
    os.makedirs(tmp_path / "in")
    want = []
    for name in ("a", "b", "empty"):
        data = b""
        for i in range(0 if name == "empty" else 60):
            # payloads that hold the signs of a member, whole members, and much that does not compress
            payload = rng.choice([b"", b"\x1f\x8b\x08" * 5, gzip.compress(b"WARC-less"), rng.randbytes(rng.randint(0, 30_000)), b"x" * 2_000_000])
            want.append((f"http://x/{name}{i}", len(payload), payload[:20]))
            data += gzip.compress(warc(f"{name}{i}", payload))
        (tmp_path / "in" / f"{name}.warc.gz").write_bytes(data)
    return f"file://{tmp_path}/in", sorted(want)


def rows(df):
    return sorted((r.headers["warc-target-uri"], len(r.payload), bytes(r.payload)[:20]) for r in df.collect())


@pytest.mark.parametrize("split", [997, 40_000, 1 << 30])
def test_members_once_at_any_split(folder, split):
    path, want = folder
    got = []
    for name in ("a", "b"):
        at = f"{path[7:]}/{name}.warc.gz"
        size = os.path.getsize(at)
        for lo in range(0, size, split):
            got += [(h["warc-target-uri"], len(p), p[:20]) for _, _, _, h, p in members(path, Range(at, lo, min(lo + split, size)))]
    assert sorted(got) == want


def test_archives_as_table_and_stream(spark, folder, tmp_path):
    path, want = folder
    df = read_archives(spark, path, split_bytes=30_000)
    assert rows(df) == want and df.rdd.getNumPartitions() > 10
    one = gzip.compress(b"".join(warc(i, b"p" * i) for i in range(50)))  # a single member
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "x.gz").write_bytes(one)
    assert read_archives(spark, f"file://{tmp_path}/one", split_bytes=100).count() == 50
    stream = read_archives(spark, path, split_bytes=200_000, stream=True)
    assert rows(drain(stream, f"file://{tmp_path}/rows", f"file://{tmp_path}/state", "append")) == want


def test_token_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 65_000, n).tolist() for n in (0, 5, 4000, 1, 9000)]
    df = spark.createDataFrame([(x, "t") for x in ids], "ids array<int>, text string").coalesce(1)
    made = sinks.write_token_files(df, f"file://{tmp_path}/t", 7).collect()
    whole = [t for x in ids for t in (*x, 7)]
    assert [(r.docs, r.tokens, r.bytes) for r in made] == [(5, len(whole), 2 * len(whole))]
    get = lambda **k: [(r.pos, r.token) for r in read_tokens(spark, f"file://{tmp_path}/t", **k).orderBy("pos").collect()]
    assert get(split_tokens=333) == list(enumerate(whole))
    assert get(ranges=[(10, 20), (4000, 4001)]) == [(i, whole[i]) for i in (*range(10, 20), 4000)]
    assert get(ranges=[]) == [] and get(ranges=[(99_999, 100_000)]) == []


@pytest.mark.parametrize("after", [False, True])
def test_chunks_at_delimiters(spark, tmp_path, after):
    rng = random.Random(5)
    os.makedirs(tmp_path / "d")
    files = {n: "<|e|>".join("é" * rng.randint(0, 60) for _ in range(40)).encode() for n in ("a", "b")} | {"none": b"x" * 500, "empty": b""}
    for n, data in files.items():
        (tmp_path / "d" / n).write_bytes(data)
    for size in (7, 300, 10_000):
        got = {}
        for r in delimited_chunks(spark, f"file://{tmp_path}/d", "<|e|>", size, after).collect():
            got.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.start, r.end, bytes(r.content)))
        for n, data in files.items():
            own = sorted(got.get(n, []))
            assert b"".join(x for _, _, x in own) == data and all(a[1] == b[0] for a, b in zip(own, own[1:]))
            assert all(data[: b].endswith(b"<|e|>") if after else x.startswith(b"<|e|>") for b, _, x in own[1:])
            assert size != 300 or n != "a" or 1 < len(own) <= -(-len(data) // 300)
