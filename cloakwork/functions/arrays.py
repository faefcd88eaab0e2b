"""Array expressions whose cost stays near linear in the length of the array.

A fold copies its accumulator at each element, so one that appends to it is quadratic. The scan below works in
blocks of about the square root of the length: n^1.5 copies at most, whatever is scanned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def record(**fields: Column) -> Column:
    """A struct; aliases would be lost inside of arrays."""
    return F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)])


def blocks(v: Column) -> Column:
    """An array that isn't empty, cut into blocks of about the square root of its length."""
    width = F.ceil(F.sqrt(F.size(v))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda b: F.slice(v, b * width + 1, width))


def prefix(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running results of an associative ``combine``: [v1, v1 + v2, ...]."""

    def grown(block: Column) -> Column:
        return F.aggregate(F.slice(block, F.lit(2), F.size(block)), F.slice(block, F.lit(1), F.lit(1)), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def cut(v: Column) -> Column:
        return F.transform(blocks(v), grown)

    def joined(parts: Column) -> Column:
        totals = grown(F.transform(parts, lambda x: F.element_at(x, -1)))
        return let(totals, lambda t: F.flatten(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda y: combine(F.get(t, i - 1), y))))))

    return let(values, lambda v: F.when(F.size(v) < 2, v).otherwise(let(cut(v), joined)))


def running_sum(values: Column) -> Column:
    return prefix(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return prefix(values, lambda a, b: F.greatest(a, b))


def runs(values: Column, fresh: Callable[[Column, Column], Column]) -> Column:
    """Slices of an array; the first element and each one for which fresh(element, its place) begin one."""

    def sliced(v: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | fresh(F.get(v, i), i))
        return let(starts, lambda s: F.transform(s, lambda at, k: F.slice(v, at + 1, F.coalesce(F.get(s, k + 1), F.size(v)) - at)))

    return let(values, lambda v: F.when(F.size(v) > 0, sliced(v)).otherwise(F.transform(v, lambda x: F.array(x))))


#: Pieces of a long text are cut out of chunks of so many code points, since a substring is found by counting from the start.
CHUNK = 1000


def slices(text: Column, ranges: Column) -> Column:
    """The text's pieces [first, last) of an array of structs (first, last), one a range."""
    empty = F.array().cast("array<string>")

    def cut(chunks: Column, r: Column) -> Column:
        one = lambda k: let(F.greatest(r["first"] - k * CHUNK, F.lit(0)), lambda a: F.get(chunks, k).substr(a + 1, F.least(r["last"] - k * CHUNK, F.lit(CHUNK)) - a))
        whole = F.transform(F.sequence(F.floor(r["first"] / CHUNK).cast("int"), F.floor((r["last"] - 1) / CHUNK).cast("int")), one)
        return F.when(r["last"] > r["first"], F.array_join(whole, "")).otherwise(F.lit(""))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return let(F.coalesce(chunks, empty), lambda c: F.transform(ranges, lambda r: cut(c, r)))


def pieces(text: Column, ranges: Column, between: str = "") -> Column:
    """The text's pieces [first, last) of an array of structs (first, last) in order, with ``between`` after all but the last."""
    return F.array_join(slices(text, ranges), between)
