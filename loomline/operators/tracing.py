"""What every stage of a run has done: rows, tokens and time, counted while the stage is computed."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .lineage import cut


class Trace:
    """Stages in order with their counters. The counters ride on the job that computes the stage; nothing is read twice for them."""

    def __init__(self):
        self.stages: list[tuple[str, int, int, float]] = []

    def cut(self, stage: str, rows: DataFrame, tokens: Column | None = None) -> DataFrame:
        """rows, computed once and kept, with the stage's rows, tokens (if they are to be counted) and seconds written down."""
        seen = Observation()
        counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.lit(0) if tokens is None else tokens), F.lit(0)).cast("long").alias("tokens"))
        began = time.monotonic()
        kept = cut(counted)
        found = seen.get
        self.stages.append((stage, found["rows"], found["tokens"], round(time.monotonic() - began, 3)))
        return kept

    def frame(self, spark: SparkSession) -> DataFrame:
        """(position, stage, rows, tokens, seconds)."""
        return spark.createDataFrame([(i, *s) for i, s in enumerate(self.stages)], "position int, stage string, rows long, tokens long, seconds double")


def cut_at(trace: Trace | None, stage: str, rows: DataFrame, tokens: Column | None = None) -> DataFrame:
    """rows kept, and written down if there is a trace."""
    return cut(rows) if trace is None else trace.cut(stage, rows, tokens)


def totals(trace: Trace, kinds: Sequence[tuple[str, str]]) -> dict[str, int]:
    """Rows of the stages that stand for kinds (name, stage); 0 for a stage that did not run."""
    rows = {stage: n for stage, n, _, _ in trace.stages}
    return {name: rows.get(stage, 0) for name, stage in kinds}
