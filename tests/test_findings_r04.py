"""Tables on which queries once gave other rows than their SQL, or did work or held memory beyond what their rows ask for."""

from __future__ import annotations

import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from compare import assert_same

from loomline.llm import neighbours
from loomline.operators import communities
from loomline.plans.registry import QUERIES, SQL


def test_empty_texts_and_entities_in_texts_are_sanitized_as_in_sql(spark, tmp_path):
    texts = [None, "", "  ", "\x01 \x7f", "a &amp; b", "&lt;b&gt;", "&#65;&#1;&#x80;", "&copy 2 &notit;", "R&D &", "&\x01amp;", " \u00a0x\u00a0 \n", "plain", "\t tab\x00s &&amp;amp; "]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts}), tmp_path / "documents.parquet")
    assert_same(QUERIES["texts_sanitized"](spark, str(tmp_path)), SQL["texts_sanitized"], str(tmp_path))


def _most_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_fits_of_lists_hold_few_distances():
    x = np.random.default_rng(5).normal(size=(65_536, 4))
    # 4096 x 4096 distances are 134 MB, 64 x 65,536 are 34 MB and were held several times
    assert _most_mb(lambda: neighbours.fit(x[:32_768], 4096)) < 110
    graph = neighbours.fit(x[:4096], 64)
    assert _most_mb(lambda: neighbours.fit_ratio(x, graph, 10)) < 70


def _shuffled_rows(spark) -> int:
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rounds_of_louvain_shuffle_blocks_not_edges(spark):
    pairs = [(f"n{g}_{a}", f"n{g}_{b}") for g in range(10) for a, b in itertools.combinations(range(60), 2)]
    edges = spark.createDataFrame(pairs, "src string, tgt string").localCheckpoint()
    before = _shuffled_rows(spark)
    found, _ = communities.louvain(edges, rounds=6, levels=1)
    assert found.select("community").distinct().count() >= 10
    # a round used to shuffle each edge both ways, and there are up to seven
    assert _shuffled_rows(spark) - before < 4 * 2 * len(pairs)


def test_louvain_is_the_same_over_few_and_many_parts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pairs = [(f"x{a}", f"x{b}", float(rng.integers(1, 5))) for a, b in rng.integers(0, 120, (900, 2)) if a // 20 == b // 20 or rng.random() < 0.1]
    pairs += [("x3", "x3", 2.0), *pairs[:40]]
    edges = spark.createDataFrame(pairs, "src string, tgt string, weight double")
    assert communities._parts(2 * len(pairs)) == 1
    one, q = communities.louvain(edges, "weight", rounds=8)
    one = sorted(map(tuple, one.collect()))
    monkeypatch.setattr(communities, "PART_EDGES", 40)
    monkeypatch.setattr(communities, "BLOCK_EDGES", 4)
    assert communities._parts(2 * len(pairs)) > 5
    many, r = communities.louvain(edges, "weight", rounds=8)
    assert sorted(map(tuple, many.collect())) == one and abs(q - r) < 1e-12
    own = spark.createDataFrame(one, "id string, community string")
    assert abs(communities.modularity(communities.weighted(edges, "weight"), own) - q) < 1e-9 and q > 0.3
