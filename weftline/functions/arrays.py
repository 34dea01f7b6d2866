"""Steps over an array within its row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for each row, not for each element that a function in it looks at."""
    return F.transform(F.array(value), use)[0]


def array_runs(values: Column, key: Callable[[Column], Column], made: Callable[[Column, Column], Column]) -> Column:
    """``made`` of the place (from 0) and the number of each run of elements with equal ``key`` in an array; null if it is null."""
    starts = F.filter(F.transform(values, lambda x, i: F.when((i == 0) | ~key(x).eqNullSafe(key(F.get(values, i - 1))), i)), lambda i: i.isNotNull())
    return let(starts, lambda at: F.transform(at, lambda i, k: made(i, F.coalesce(F.get(at, k + 1), F.size(values)) - i)))
