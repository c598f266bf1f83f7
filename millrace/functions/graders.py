"""Whether a text repeats itself: common prefixes of neighbouring suffixes.

Suffixes are ordered by prefix doubling: with the order of all suffixes by their first h
characters, that by 2 h needs one sort of pairs of ranks, and only of suffixes that still
share a rank. The ranks of each round then give the common prefixes of neighbours, longest
jumps first. All texts of a chunk are ordered at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_CHARS = 1 << 18


def _ranked(points: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes, text by text, and their ranks by 1, 2, 4 ... characters; equal ranks are equal prefixes."""
    n = len(points)
    key = text * (int(points.max()) + 1) + points
    order = np.argsort(key, kind="stable")
    own = key[order]
    first = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = first
    levels, h = [rank.copy()], 1
    shared = np.append(first[1:] == first[:-1], False)
    open_ = np.flatnonzero(shared | np.append(False, shared[:-1]))  # places in the order whose rank is shared
    while len(open_):
        at = order[open_]
        on = np.minimum(at + h, n - 1)
        follows = np.where((at + h < n) & (text[on] == text[at]), rank[on] + 1, 0)  # the end comes before any character
        place = np.lexsort((follows, rank[at]))
        at, follows, group = at[place], follows[place], rank[at][place]
        order[open_] = at
        new = np.append(True, (group[1:] != group[:-1]) | (follows[1:] != follows[:-1]))
        first = np.maximum.accumulate(np.where(new, open_, 0))
        rank[at] = first
        levels.append(rank.copy())
        shared = np.append(~new[1:], False)
        open_ = open_[shared | np.append(False, shared[:-1])]
        h *= 2
    return order, levels


def prefix_scores(texts: list[str]) -> np.ndarray:
    """2 * sum of neighbouring suffixes' common prefixes / (n (n + 1)) of each text; 0 for one character or none."""
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    total = np.zeros(len(texts))
    if len(points):
        text = np.repeat(np.arange(len(texts)), lens)
        n = len(points)
        order, levels = _ranked(points, text)
        ends = np.cumsum(lens)[text]
        a, b = order[:-1], order[1:]
        shared = np.zeros(n - 1, dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + shared, b + shared
            inside = (x + (1 << k) <= ends[a]) & (y + (1 << k) <= ends[b])
            same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
            shared += same.astype(np.int64) << k
        shared[text[a] != text[b]] = 0
        total = np.bincount(text[a], weights=shared, minlength=len(texts))
    return np.where(lens > 1, 2 * total / np.maximum(lens * (lens + 1), 1), 0.0)


def common_prefix_repetition(text: str) -> float:
    return float(prefix_scores([text])[0])


@F.pandas_udf(T.DoubleType())
def repetition(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``prefix_scores`` of each text, in chunks of about ``CHUNK_CHARS`` characters; null stays null. A text takes about 40
    bytes of memory a character, and 8 more for each doubling of its longest repeat."""
    for s in batches:
        out, texts, places, size = pd.Series([None] * len(s), index=s.index, dtype="float64"), [], [], 0
        for i, t in enumerate(s):
            if t is not None:
                texts.append(t)
                places.append(i)
                size += len(t)
            if texts and (size >= CHUNK_CHARS or i == len(s) - 1):
                out.iloc[places] = prefix_scores(texts)
                texts, places, size = [], [], 0
        if texts:
            out.iloc[places] = prefix_scores(texts)
        yield out


def is_repetitive(text, limit: float = 0.2):
    """Whether a text's neighbouring suffixes share more than ``limit`` of their characters."""
    return repetition(text) > limit
