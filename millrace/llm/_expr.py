"""Column helpers shared by the operators that use DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once a row.

    A column that is named inside a lambda would otherwise be computed again for each
    element, since the optimizer merges projections into lambdas.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def _running(xs: Column, fold, zero: Column, block: int) -> Column:
    """Inclusive prefixes of an array of longs under an associative ``fold``.

    Totals of whole blocks come first; an element then folds what precedes it in its own
    block. That keeps the work near ``block`` steps an element and copies nothing that
    grows, where a fold that appends would copy its result at every step.
    """
    total = lambda a: F.aggregate(a, zero, fold)
    div = lambda i: F.floor(i / block).cast("int")

    def with_blocks(a: Column, totals: Column) -> Column:
        return let(
            F.transform(totals, lambda x, i: total(F.slice(totals, F.lit(1), i))),
            lambda before: F.transform(
                a, lambda x, i: fold(F.get(before, div(i)), total(F.slice(a, div(i) * block + 1, i - div(i) * block + 1)))
            ),
        )

    def blocks(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), div(F.size(a) - 1)), lambda b: total(F.slice(a, b * block + 1, F.lit(block))))

    return F.when(F.size(xs) > 1, let(xs, lambda a: let(blocks(a), lambda totals: with_blocks(a, totals)))).otherwise(xs)


def running_sums(xs: Column, block: int = 64) -> Column:
    """Inclusive prefix sums of an array of longs."""
    return _running(xs, lambda acc, x: acc + x, F.lit(0).cast("long"), block)


def running_max(xs: Column, block: int = 64) -> Column:
    """Inclusive prefix maxima of an array of longs that are not negative."""
    return _running(xs, lambda acc, x: F.greatest(acc, x), F.lit(0).cast("long"), block)
