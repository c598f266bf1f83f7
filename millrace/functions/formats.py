"""Text forms: folding, digit groups, instruction prompts, short numbers, bounded previews."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The instruction prompt that models are tuned on, and the size suffixes.
INSTRUCTION = (
    "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n", "\n\n### Response:\n",
)
THOUSANDS = ((10**12, "T"), (10**9, "B"), (10**6, "M"), (10**3, "K"))
BINARY = ((2**40, "TiB"), (2**30, "GiB"), (2**20, "MiB"), (2**10, "KiB"))


def fold(text: str | None) -> str | None:
    """Lower case without combining marks; punctuation and white space are single blanks."""
    if text is None:
        return None
    bare = (c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return re.sub(r"\s+", " ", "".join(" " if unicodedata.category(c)[0] == "P" else c for c in bare)).strip()


@pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """``fold`` of a column: Spark has no canonical decomposition of its own."""
    return text.map(fold, na_action="ignore")


def split_digits(text: Column, size: int = 1) -> Column:
    """Blanks after each ``size`` digits of a run, counted from its left end."""
    return F.regexp_replace(text, rf"(\p{{Nd}}{{{size}}})(?=\p{{Nd}})", "$1 ")


def instruction_prompt(instruction: Column, response: Column) -> Column:
    return F.concat(F.lit(INSTRUCTION[0]), instruction, F.lit(INSTRUCTION[1]), response)


def is_safe(verdict: Column) -> Column:
    """A judge's verdict calls a text unsafe by beginning with "true"; null stays null."""
    return ~F.lower(F.trim(verdict)).startswith("true")


def short_number(n: Column, scales: tuple[tuple[int, str], ...] = THOUSANDS) -> Column:
    """A whole number in tenths of its largest scale, halves to even: 1500 is 1.5K, 2000 is 2K."""
    out = n.cast("string")
    for scale, suffix in reversed(scales):
        tenths, rest = F.floor(n * 10 / F.lit(scale)).cast("long"), F.pmod(n * 10, F.lit(scale))
        up = (rest * 2 > scale) | ((rest * 2 == scale) & (tenths % 2 == 1))
        t = tenths + up.cast("long")
        text = F.concat(F.floor(t / 10).cast("string"), F.when(t % 10 != 0, F.concat(F.lit("."), (t % 10).cast("string"))).otherwise(""), F.lit(suffix))
        out = F.when(n >= scale, text).otherwise(out)
    return out


def preview(text: Column, tokens: int = 512, chars: int = 8192) -> Column:
    """The first ``tokens`` words and signs of the first ``chars`` characters, blank between."""
    return F.array_join(F.slice(F.regexp_extract_all(F.substring(text, 1, chars), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)), 1, tokens), " ")
