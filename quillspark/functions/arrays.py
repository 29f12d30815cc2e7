"""Arrays of structs that keep their order: distinct by a key, groups by first sight, runs of limited size; names of columns that steps need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scalars import bound


def first_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """The first item of each key, in the order of the array: sorted by (key, place), neighbours compared, and sorted back by place."""
    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    firsts = bound(keyed, lambda s: F.filter(s, lambda x, i: (i == 0) | ~x["k"].eqNullSafe(F.get(s, F.greatest(i - 1, F.lit(0)))["k"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x")))), lambda x: x["x"])


def grouped_by(items: Column, key: str, value: str) -> Column:
    """Array of (key, values): groups in the order in which their keys are first seen, values in that of the array."""

    def of(a: Column) -> Column:
        keys = F.array_distinct(F.transform(a, lambda x: x[key]))
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.transform(F.filter(a, lambda x: x[key].eqNullSafe(k)), lambda x: x[value]).alias("values")))

    return bound(items, of)


def chunked(items: Column, size: int) -> Column:
    """Array of the arrays of at most ``size`` neighbours; none of an empty array."""
    count = F.ceil(F.size(items) / size).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(items, i * size + 1, F.lit(size)))).otherwise(F.slice(F.array(items), 1, 0))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until the table has no such column, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out
