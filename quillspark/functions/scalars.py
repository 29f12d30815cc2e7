"""Small numeric, time, array and JSON functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, not once per use of it in nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bounded_score(c: Column) -> Column:
    """Rounded half to even, within 0 and 100."""
    return F.least(F.greatest(F.bround(c, 0), F.lit(0)), F.lit(100)).cast("int")


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Per cent of the whole, 0 when that is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / whole, digits))


def safe_ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def ceil_div(n: Column, d: int) -> Column:
    return F.floor((n + (d - 1)) / d)


def backoff(attempt: Column, base: float = 10.0, most: float = 300.0) -> Column:
    """Exponential wait before an attempt, counted from 1."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(most))


def first_match(items: Column, test, default: Column) -> Column:
    return F.coalesce(F.get(F.filter(items, test), F.lit(0)), default)


def in_chunks(items: Column, size: int) -> Column:
    """An array in arrays of at most ``size``."""
    n = F.ceil(F.size(items) / size).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(items, i * size + 1, size)))


def json_number(payload: Column, path: str, kind: str = "int") -> Column:
    """A number at a JSON path, null where it's missing or something else."""
    return F.get_json_object(payload, path).try_cast(kind)


def embedded_object(text: Column) -> Column:
    """The JSON object in a text: the fenced block if there is one, else from the first { to the last }."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0))
