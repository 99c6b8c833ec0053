"""Ordered sets of ids in arrays, and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "<SEP>"


def merged(a: Column, b: Column) -> Column:
    """a, then what b adds, in order, without blanks."""
    return F.array_distinct(F.filter(F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array())), lambda x: x != ""))


def subtracted(a: Column, b: Column) -> Column:
    """a without the members of b; repeats in a stay."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def incremental(old: Column, new: Column, full: Column) -> Column:
    """full after a change from old to new: what old lost is taken out, what new has more is put behind."""
    lost, more = F.array_except(old, new), F.array_except(new, old)
    return F.array_distinct(F.concat(subtracted(full, lost), more))


def capped(ids: Column, most: int, method: str = "KEEP") -> Column:
    """At most so many ids: KEEP the oldest (the head), FIFO the newest (the tail)."""
    if method == "FIFO":
        return F.when(F.size(ids) > most, F.slice(ids, -most, most)).otherwise(ids)
    return F.slice(ids, 1, most)


def content_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.md5(text))


def pair_key(a: Column, b: Column) -> Column:
    """The key of an undirected relation."""
    return F.concat(F.least(a, b), F.lit(SEPARATOR), F.greatest(a, b))
