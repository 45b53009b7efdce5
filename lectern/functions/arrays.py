"""Column helpers over arrays that Spark's built-ins lack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column],
         emit: Callable[[Column], Column], empty: Column) -> tuple[Column, Callable[[Column], Column]]:
    """Walk an array with a state, keeping what ``emit`` says of the state after
    each item.  Returns a struct column and a reader: ``reader(struct)`` gives
    the struct's ``state`` (the last one) and ``out`` (array of what was kept).

    ``empty`` is an empty array of the emitted type.  Results are gathered in
    blocks, so appending costs n * sqrt(n) at worst, not the n * n of one long
    accumulator."""
    blocks = let(items, lambda xs: F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(xs) - 1) / F.lit(_BLOCK)).cast("int"), F.lit(0))),
        lambda b: F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK))))

    def one(acc: Column, item: Column) -> Column:
        return let(step(acc["state"], item), lambda s: F.struct(s.alias("state"), F.array_append(acc["out"], emit(s)).alias("out")))

    def block(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["state"].alias("state"), empty.alias("out")), one)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.array_append(acc["out"], d["out"]).alias("out")))

    nested = F.array_remove(F.array(empty), empty)          # no block yet, of the right type
    walked = F.aggregate(blocks, F.struct(zero.alias("state"), nested.alias("out")), block)
    return walked, lambda w: F.struct(w["state"].alias("state"), F.flatten(w["out"]).alias("out"))
