"""Arithmetic of page packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of a line, capacity of a page in units, least fill, tolerance below it.
LINE, CAPACITY, LEAST_FILL, TOLERANCE = 116, 21, 10, 3


def item_units(length: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(3), F.floor((length + LINE - 1) / LINE).cast("int")))


def units(headings: Column, lengths: Column) -> Column:
    """Height of an entry: 2, its headings, and 1 to 3 for each item by length; 3 at least."""
    return F.greatest(F.lit(3), F.aggregate(F.transform(lengths, item_units), F.lit(2) + headings, lambda a, x: a + x))


def page_breaks(heights: Column, capacity: int = CAPACITY) -> Column:
    """Indices (from 0) of entries that begin a new page, from the ordered array of heights. A greedy fold."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("breaks"))

    def step(a: Column, h: Column) -> Column:
        fits = (a["used"] + h <= capacity) | ((a["used"] < LEAST_FILL) & (a["used"] + h <= capacity + TOLERANCE))
        new = (a["i"] > 0) & ~fits
        used = F.when((a["i"] == 0) | new, F.least(h, F.lit(capacity))).otherwise(a["used"] + h)
        return F.struct((a["i"] + 1).alias("i"), used.alias("used"), F.when(new, F.concat(a["breaks"], F.array(a["i"]))).otherwise(a["breaks"]).alias("breaks"))

    return F.aggregate(F.transform(heights, lambda h: h.cast("int")), start, step, lambda a: a["breaks"])
