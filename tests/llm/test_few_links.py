"""Components of few links are found by one task, with the same result as by rounds of joins."""

from __future__ import annotations

import random

from loomline.llm import groups
from loomline.llm.shared import Tables


def test_components_of_few_links_take_two_tables(spark, monkeypatch):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    df = spark.createDataFrame(links, "a long, b long").repartition(16)
    tables = Tables(spark)
    few = sorted(map(tuple, groups.components(df, tables).collect()))
    assert tables.n == 2
    monkeypatch.setattr(groups, "FEW", -1)
    rounds = Tables(spark)
    assert sorted(map(tuple, groups.components(df, rounds).collect())) == few and rounds.n > 2
    assert {r for n, r in few if n >= 1000} == {1000}
