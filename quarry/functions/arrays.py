"""Array helpers over Spark's higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. A column named in a lambda is otherwise computed
    again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_fold(a: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The fold of every prefix of ``a`` (a lambda's variable), as one array per element.

    Spark's ``aggregate`` can return an array only by copying it at every step, which is quadratic.
    Here the folds up to every 4,096th element are found first, from these the folds up to every
    64th, and from those all: an element costs about 64 steps, whatever the size of the array
    (beyond some 300,000 elements the first level begins to count)."""
    def fold(start: Column, length: Column, state: Column) -> Column:
        return F.aggregate(F.slice(a, start + 1, length), state, step)

    def blocks(size: int) -> Column:
        return F.sequence(F.lit(0), F.floor(F.greatest(F.size(a) - 1, F.lit(0)) / size).cast("int"))

    def at(states: Column, k: Column) -> Column:
        return F.get(states, F.floor(k / BLOCK).cast("int"))
    far = F.transform(blocks(BLOCK * BLOCK), lambda k: fold(F.lit(0), k * BLOCK * BLOCK, zero))
    return let(far, lambda f: let(
        F.transform(blocks(BLOCK), lambda k: fold(
            (k - k % BLOCK) * BLOCK, k % BLOCK * BLOCK, at(f, k))),
        lambda n: F.transform(a, lambda _, i: fold(i - i % BLOCK, i % BLOCK + 1, at(n, i)))))
