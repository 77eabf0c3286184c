"""Spans of regular expressions in texts, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,found:string>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def alternate(text: Column, pattern: str | Column) -> Column:
    """The text cut at the leftmost matches: structs of a gap and the match after it (null after the last gap)."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.zip_with(F.split(text, pattern, F.lit(-1)), F.concat(found, F.array(F.lit(None).cast("string"))), lambda g, m: F.struct(g.alias("gap"), m.alias("found")))


def before(lengths: Column) -> Column:
    """For each length of an array the sum of those before it. A fold copies its state at every step, so a growing list
    in it takes quadratic time; here the array is cut into blocks, which are summed, and only sums are folded: about
    n^(4/3) additions."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, n: s + n)

    def within(block: Column, start: Column) -> Column:
        return let(start, lambda at: F.transform(block, lambda _, i: at + total(F.slice(block, F.lit(1), i))))

    def cut(a: Column) -> Column:
        width = F.ceil(F.pow(F.size(a), F.lit(1 / 3))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")), lambda k: F.slice(a, k * width + 1, width))
        summed = lambda b: let(F.transform(b, total), lambda t: F.flatten(F.transform(b, lambda x, k: within(x, total(F.slice(t, F.lit(1), k))))))
        return F.when(F.size(a) > 0, let(blocks, summed)).otherwise(F.array().cast("array<int>"))

    return let(lengths, cut)


def placed(cuts: Column, at: Column) -> Column:
    """Structs of where a cut of alternate() starts (its gap, counted from at), its gap and its match."""

    def zipped(c: Column) -> Column:
        sizes = F.transform(c, lambda x: F.char_length(x["gap"]) + F.coalesce(F.char_length(x["found"]), F.lit(0)))
        return F.zip_with(c, before(sizes), lambda x, n: F.struct((at + n).alias("at"), x["gap"].alias("gap"), x["found"].alias("found")))

    return let(cuts, zipped)


def spans(text: Column, pattern: str | Column) -> Column:
    """start and end (code points, end exclusive) and text of each leftmost match."""

    def one(x: Column) -> Column:
        start = x["at"] + F.char_length(x["gap"])
        return F.struct(start.alias("start"), (start + F.char_length(x["found"])).alias("end"), x["found"].alias("found"))

    matched = F.filter(placed(alternate(text, pattern), F.lit(0)), lambda x: x["found"].isNotNull())
    return F.when(F.rlike(text, F.lit(pattern) if isinstance(pattern, str) else pattern), F.transform(matched, one)).otherwise(F.array().cast(SPAN))
