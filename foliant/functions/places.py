"""Places in a text, with built-in functions whose work grows with the text and the places, not with their product."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a chunk, see `chunks`.
CHUNK = 1_024
_POWERS = tuple(1 << i for i in range(30))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Each value combined with all before it, by doubling: a pass over the array for each power of two below its size."""

    def double(done: Column, p: Column) -> Column:
        n = F.size(done)
        before = F.concat(F.array_repeat(F.lit(0), p), F.slice(done, F.lit(1), n - p))
        return F.zip_with(done, before, combine)

    def scanned(v: Column) -> Column:
        return F.aggregate(F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p < F.size(v)), v, double)

    return once(values.cast("array<int>"), scanned)


def running_totals(values: Column) -> Column:
    """Inclusive sums of an array of int, none of them null."""
    return _scan(values, lambda a, b: a + b)


def running_maxima(values: Column) -> Column:
    """Inclusive maxima of an array of int, none of them null or negative."""
    return _scan(values, lambda a, b: F.greatest(a, b))


def match_places(text: Column, pattern: str) -> Column:
    """array<struct<found,start,end>> in code points: matches lie between the pieces that a split by the same pattern leaves.
    The pattern must not match the empty string."""

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = running_totals(F.zip_with(gaps, found, lambda g, f: F.length(g) + F.length(f)))
        return F.zip_with(found, ends, lambda f, end: F.struct(f.alias("found"), (end - F.length(f)).alias("start"), end.alias("end")))

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def chunks(text: Column) -> Column:
    """The text in pieces of CHUNK code points, so that `between` needn't walk from the text's start."""
    return F.when(F.length(text) <= CHUNK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}+"), F.lit(0)))


def between(cut: Column, start: Column, end: Column) -> Column:
    """The text from start to before end (code points), out of its chunks."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.least(F.floor(F.greatest(end - 1, start) / CHUNK).cast("int"), F.size(cut) - 1)
    joined = F.array_join(F.slice(cut, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.substring(joined, start - first * CHUNK + 1, F.greatest(end - start, F.lit(0)))
