"""Which declaration of a style sheet holds, and whether it is the one that is expected."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Expected(NamedTuple):
    """At a width, a selector's property is, holds (a part of it), is at least (a length), or is the flex-basis."""

    selector: str
    prop: str
    width: float
    kind: str
    want: str


def applies(width: Column) -> Column:
    """Whether a declaration's range of widths, either end of which may be open, holds the width."""
    return F.coalesce(F.col("min_width") <= width, F.lit(True)) & F.coalesce(width <= F.col("max_width"), F.lit(True))


def resolved(declarations: DataFrame, widths: Sequence[float], by: Sequence[str] = (), order: Sequence[str] = ("file", "ord")) -> DataFrame:
    """(by..., selector, prop, width, value): the last declared value of those that apply. by: what each set of sheets is
    told apart by; order: the files of a set by name, and declarations within. One aggregation, of which tasks send one
    value for each result."""
    at = declarations.withColumn("width", F.explode(F.array(*(F.lit(float(w)) for w in widths)))).where(applies(F.col("width")))
    return at.groupBy(*by, "selector", "prop", "width").agg(F.max_by("value", F.struct(*order)).alias("value"))


def satisfied(value: Column, kind: Column, want: Column) -> Column:
    """A missing value satisfies nothing. A flex-basis may stand alone or behind the growth and shrinkage of 1."""
    number = F.expr("try_cast(regexp_extract(value, '^\\\\s*([-+]?[0-9]*[.]?[0-9]+)', 1) as double)")
    plain = F.regexp_replace(F.trim(value), r"\s+", " ")
    holds = F.when(kind == "is", value == want).when(kind == "holds", F.contains(value, want)).when(kind == "at_least", number >= want.try_cast("double")).when(kind == "basis", (plain == want) | (plain == F.concat(F.lit("1 1 "), want)))
    return F.coalesce(holds, F.lit(False))


def failures(declarations: DataFrame, expected: Sequence[Expected], keys: DataFrame | None = None, by: Sequence[str] = (), order: Sequence[str] = ("file", "ord")) -> DataFrame:
    """(by..., selector, prop, width, kind, want, value): what is expected and does not hold, value null where nothing
    applies. keys (by...): the sets of sheets that must satisfy it, also those without any declaration; with no keys the
    declarations are one set."""
    spark = declarations.sparkSession
    pairs = sorted({(e.selector, e.prop) for e in expected})
    asked = reduce(lambda a, b: a | b, ((F.col("selector") == s) & (F.col("prop") == p) for s, p in pairs))
    found = resolved(declarations.where(asked), sorted({float(e.width) for e in expected}), by, order)
    rows = F.array(*(F.struct(F.lit(e.selector).alias("selector"), F.lit(e.prop).alias("prop"), F.lit(float(e.width)).alias("width"), F.lit(e.kind).alias("kind"), F.lit(e.want).alias("want")) for e in expected))
    wanted = (spark.range(1).select() if keys is None else keys.select(*by)).select(*by, F.inline(rows))
    return wanted.join(found, [*by, "selector", "prop", "width"], "left").where(~satisfied(F.col("value"), F.col("kind"), F.col("want")))
