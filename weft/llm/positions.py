"""Where a pattern's matches stand in a text, from gaps and matches, by native functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(gaps: Column, lengths: Column, values: Column, value_type: str = "int", chunk: int = 64) -> Column:
    """array<struct<s, e, v>>: start and end of each match, and its value.

    ``gaps`` are the lengths of the texts between matches, one more than there are ``lengths``.  A
    fold over the whole array would copy what it has found at each match; so chunks are folded by
    themselves, each from the total of the chunks before it.
    """
    empty = F.array().cast(f"array<struct<s:int,e:int,v:{value_type}>>")

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, x: acc + x["g"] + F.coalesce(x["m"], F.lit(0)))

    def placed(part: Column, start: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(start.alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["g"] + F.coalesce(x["m"], F.lit(0))).alias("at"),
                F.when(x["m"].isNull(), acc["out"])
                .otherwise(F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + x["m"]).alias("e"), x["v"].alias("v")))))
                .alias("out"),
            ),
            lambda acc: acc["out"],
        )

    def chunks(pairs: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(pairs) - 1) / chunk).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(pairs, k * chunk + 1, F.lit(chunk)))

    def starts(parts: Column) -> Column:
        return F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + total(x))))

    pairs = F.arrays_zip(gaps.alias("g"), lengths.alias("m"), values.alias("v"))
    return bind(pairs, lambda z: bind(chunks(z), lambda parts: bind(starts(parts), lambda at: F.flatten(F.transform(parts, lambda x, i: placed(x, F.get(at, i)))))))
