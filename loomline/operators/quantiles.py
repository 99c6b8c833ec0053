"""Exact quantiles of groups of any size, by narrowing ranges.

For each group and wanted rank (two for a share between ranks) a range that holds it is kept, at first from the least to the
largest value. A round cuts each range at approximate quantiles of what lies in it (a mergeable digest), counts the rows of each piece
exactly, and keeps the piece with the rank; a value that is
a cut is a piece of its own, so ranges always shrink. A range of one value, or of at most FEW rows, is done: only
those rows are ever gathered. So no task holds a group, however large or skewed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Rows of a range that may be gathered and sorted, pieces of a round, and accuracy of the cuts.
FEW, PIECES, ACCURACY = 4096, 32, 2000
#: Most ranges that go to all tasks; more are joined.
RANGES_MOST = 100_000


def _met(rows: DataFrame, ranges: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Rows with the ranges of their group in which they lie."""
    on = [rows[c].eqNullSafe(ranges[f"_{c}"]) for c in by]
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    return rows.join(F.broadcast(ranges) if n <= RANGES_MOST else ranges, [*on, inside] if on else inside).drop(*by)


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(by..., q0, q1, ...): for each share p the value at p of the way from the first to the last, interpolated between the two nearest ranks.

    Null values don't count (a group of nothing else has null quantiles); NaN is larger than any number; null group keys are a group."""
    rows = rows.select(*by, F.col(value).cast("double").alias("_v"))
    whole = rows.groupBy(*by).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    numbers = F.array(*[F.struct(F.lit(2 * i + up).alias("_q"), F.lit(float(p)).alias("_p"), F.lit(up).alias("_up")) for i, p in enumerate(shares) for up in (0, 1)])
    place = F.col("_p") * (F.col("_n") - 1)
    ranges = whole.where("_n > 0").select(*[F.col(c).alias(f"_{c}") for c in by], "_lo", "_hi", "_n", F.explode(numbers).alias("_w")).select("*", "_w.*")
    # _at: the wanted rank, counted inside the range; a share that hits a rank needs no upper one
    ranges = ranges.where((F.col("_up") == 0) | (place > F.floor(place)))
    ranges = cut(ranges.select(*[f"_{c}" for c in by], "_q", "_lo", "_hi", F.col("_n").alias("_inside"), (F.floor(place) + F.col("_up")).alias("_at")))
    keys = [f"_{c}" for c in by]
    left = rows.where("_v IS NOT NULL")
    done = ranges.where(_ready())
    open_ = ranges.where(~_ready())
    while n := open_.count():
        met = _met(left, open_, by, n)
        cuts = met.groupBy(*keys, "_q").agg(F.percentile_approx("_v", [i / PIECES for i in range(PIECES + 1)], ACCURACY).alias("_c"))
        cuts = cuts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_q").alias("__q"), F.array_distinct("_c").alias("_c"))
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_q") == F.col("__q")]
        split = cut(open_.join(cuts, on).select(*open_.columns, "_c"))
        # pieces: values equal to a cut, and values between two cuts, so that a frequent value is a piece of its own
        below = F.size(F.filter("_c", lambda c: c < F.col("_v")))
        piece = 2 * below + F.when(F.array_contains("_c", F.col("_v")), 1).otherwise(0)
        counts = _met(left, split, by, n).groupBy(*keys, "_q", "_at", piece.alias("_k")).agg(F.count("*").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        pieces = counts.groupBy(*keys, "_q", "_at").agg(F.sort_array(F.collect_list(F.struct("_k", "_m", "_lo", "_hi"))).alias("_x"))  # at most 2 * PIECES + 1
        narrowed = cut(pieces.select(*keys, "_q", _narrowed().alias("_s")).select(*keys, "_q", "_s.*"))
        done = done.unionByName(narrowed.where(_ready()))
        open_ = narrowed.where(~_ready())
    done = cut(done)
    few = _met(left, done.where("_lo < _hi"), by, done.count()).groupBy(*keys, "_q", "_at").agg(F.sort_array(F.collect_list("_v")).alias("_x"))
    found = few.select(*keys, "_q", F.element_at("_x", (F.col("_at") + 1).cast("int")).alias("_r"))
    found = found.unionByName(done.where("_lo = _hi").select(*keys, "_q", F.col("_lo").alias("_r")))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == i, F.col("_r"))).alias(f"_r{i}") for i in range(2 * len(shares))])
    out = whole.join(wide, [whole[c].eqNullSafe(wide[f"_{c}"]) for c in by] or F.lit(True), "left")
    results = []
    for i, p in enumerate(shares):
        part = F.lit(float(p)) * (F.col("_n") - 1) - F.floor(F.lit(float(p)) * (F.col("_n") - 1))
        between = F.col(f"_r{2 * i}") * (1 - part) + F.col(f"_r{2 * i + 1}") * part
        results.append(F.when(part == 0, F.col(f"_r{2 * i}")).otherwise(between).alias(f"q{i}"))
    return out.where("_n IS NOT NULL").select(*[whole[c] for c in by], *results)


def _ready() -> Column:
    return (F.col("_inside") <= FEW) | (F.col("_lo") == F.col("_hi"))


def _narrowed() -> Column:
    """From pieces (_k, _m, _lo, _hi) in order: the piece with the wanted rank, as a range, and the rank inside it."""
    at = F.col("_at")
    none = F.lit(None).cast("double")
    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("inside"), F.lit(0).cast("long").alias("rank"), none.alias("lo"), none.alias("hi"))

    def step(s: Column, x: Column) -> Column:
        after = s["seen"] + x["_m"]
        here = (s["seen"] <= at) & (at < after)
        return F.struct(
            after.alias("seen"), F.when(here, x["_m"]).otherwise(s["inside"]).alias("inside"), F.when(here, at - s["seen"]).otherwise(s["rank"]).alias("rank"),
            F.when(here, x["_lo"]).otherwise(s["lo"]).alias("lo"), F.when(here, x["_hi"]).otherwise(s["hi"]).alias("hi"),
        )

    return F.aggregate("_x", zero, step, lambda s: F.struct(s["lo"].alias("_lo"), s["hi"].alias("_hi"), s["inside"].alias("_inside"), s["rank"].alias("_at")))
