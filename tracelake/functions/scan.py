"""A left-to-right pass over an array with a state, in time linear in the array.

``aggregate`` copies what it has gathered at each step.  Gathering within blocks of a fixed size, and
block by block outside, keeps the copies small however long the array is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def none(kind: str) -> Column:
    return F.from_json(F.lit("[]"), f"array<{kind}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once and stands in the expression once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What ``step`` gives for each item, one after the other, as one array of ``kind``.

    ``step`` takes (state, item) and gives (next state, array of what the item adds).
    """

    def inner(done: Column, item: Column) -> Column:
        after, added = step(done["state"], item)
        return F.struct(after.alias("state"), F.concat(done["out"], added).alias("out"))

    def outer(done: Column, block: Column) -> Column:
        found = F.aggregate(block, F.struct(done["state"].alias("state"), none(kind).alias("out")), inner)
        return let(found, lambda f: F.struct(f["state"].alias("state"), F.concat(done["out"], F.array(f["out"])).alias("out")))

    def whole(items: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(BLOCK))
        blocks = F.transform(starts, lambda at: F.slice(items, at, F.lit(BLOCK)))
        return F.flatten(F.aggregate(blocks, F.struct(state.alias("state"), none(f"array<{kind}>").alias("out")), outer)["out"])

    return let(items, whole)
