"""Building blocks over long arrays and texts in one row, linear (or nearly) in their length.

A fold that grows an array copies it at every step. Here such folds run over chunks, so that no step copies more than a
chunk or the list of chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of an array, and characters of a text, that are handled as one chunk.
CHUNK, CHUNK_CHARS = 256, 8192


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _pieces_of(size: Column, width: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.floor((size - 1) / width).cast("int"), F.lit(0)))


def running(numbers: Column, add: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """array<int>: the sum up to and including each element, or what else an associative ``add`` gives, from 0 on."""
    nothing = F.array().cast("array<int>")

    def within(chunk: Column) -> Column:
        return F.aggregate(chunk, F.struct(F.lit(0).alias("at"), nothing.alias("all")), lambda a, x: F.struct(add(a["at"], x).alias("at"), F.concat(a["all"], F.array(add(a["at"], x))).alias("all")))

    def whole(numbers: Column) -> Column:
        sums = F.transform(_pieces_of(F.size(numbers), CHUNK), lambda k: within(F.slice(numbers, k * CHUNK + 1, F.lit(CHUNK))))
        return F.flatten(
            F.aggregate(
                sums,
                F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("all")),
                lambda a, c: F.struct(add(a["at"], c["at"]).alias("at"), F.concat(a["all"], F.array(F.transform(c["all"], lambda x: add(a["at"], x)))).alias("all")),
            )["all"]
        )

    return bound(numbers, whole)


def chunked(text: Column) -> Column:
    """The text as chunks of CHUNK_CHARS characters, for :func:`cut`."""
    return F.transform(_pieces_of(F.length(text), CHUNK_CHARS), lambda k: text.substr(k * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS)))


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """Characters from start to end (exclusive) of a chunked text; only the chunks they touch are read."""
    first = F.floor(start / CHUNK_CHARS).cast("int")
    last = F.floor(F.greatest(end - 1, start) / CHUNK_CHARS).cast("int")
    inside = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return inside.substr(start - first * CHUNK_CHARS + 1, F.greatest(end - start, F.lit(0)))
