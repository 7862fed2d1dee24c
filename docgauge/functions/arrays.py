"""Expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def scan(values: Column, merge: Callable[[Column, Column], Column], none: int | float) -> Column:
    """values merged from the left up to each place, in log2(size) passes that double the reach; `none` is what merges to no effect."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))
    before = lambda acc, i, k: F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(none))
    return F.aggregate(passes, values, lambda acc, k: F.transform(acc, lambda x, i: merge(x, before(acc, i, k))))


def count_up_to(ordered: Column, x: Column, most: int) -> Column:
    """How many of an ordered array's values are at most x, by halving; `most` is above the array's size."""
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.coalesce(F.get(ordered, at + step - 1) <= x, F.lit(False)), step).otherwise(0))
