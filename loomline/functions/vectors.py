"""Vector expressions over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine: 1 - similarity; l2; ip: the negative inner product."""
    return {"cosine": lambda: 1 - cosine(a, b), "l2": lambda: l2(a, b), "ip": lambda: -dot(a, b)}[metric]()


def parsed(text: Column) -> Column:
    """A vector from text such as `[1,2.5]`; null if a component is no finite number."""
    v = F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x.try_cast("double"))
    return F.when(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), v)
