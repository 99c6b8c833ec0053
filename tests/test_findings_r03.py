"""Tables on which queries once gave other rows than their SQL, or did far more work than their rows ask for."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import assert_same

from loomline.operators import communities, lineage, name_index, vector_index
from loomline.plans.registry import QUERIES, SQL


@pytest.fixture
def few_rows_a_partition(spark):
    """Partitions of shuffles stay apart, as those of large tables do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def _write(folder, name: str, **columns) -> str:
    pq.write_table(pa.table(columns), folder / f"{name}.parquet")
    return str(folder)


def test_paths_of_one_name_go_by_source_and_kind(spark, tmp_path):
    sf = _write(tmp_path, "documents", doc_id=[1, 4, 3, 6, 9], text=["one", "one", "two", "two", "two"], source=["src1", "src10", "b", "B", "a/b"])
    assert_same(QUERIES["canonical_paths"](spark, sf), SQL["canonical_paths"], sf)


def test_blocks_of_candidates_meet_in_every_partition(spark, tmp_path, few_rows_a_partition):
    rng = np.random.default_rng(4)
    sf = _write(tmp_path, "embeddings", vec_id=np.arange(900), embedding=list(rng.standard_normal((900, 8)).astype(np.float32)), label=np.zeros(900, np.int32))
    assert_same(QUERIES["orphan_candidates"](spark, sf), SQL["orphan_candidates"], sf)


def test_copies_of_a_name_are_indexed_once(spark, tmp_path):
    rows = [(20 * n + i, name) for n in range(30) for i, name in enumerate(("alpha beta", "Beta, alpha", "alpha gamma", "delta"))]
    df = spark.createDataFrame(rows, "id long, name string")
    name_index.write(df, str(tmp_path / "t"), "id", "name", 4)
    assert spark.read.parquet(str(tmp_path / "t/postings")).count() < 4 * 14
    found = name_index.similar(spark, str(tmp_path / "t"), df.where("id < 40"), "id", "name", 0.5, 3, buckets=4)
    assert {r.question for r in found.collect()} == {0, 1, 2, 3, 20, 21, 22, 23}
    assert sorted((r.id, r.similarity) for r in found.where("question = 20").collect()) == [(0, 1.0), (1, 1.0), (20, 1.0)]
    assert sorted(r.id for r in found.where("question = 23").collect()) == [3, 23, 43]


@pytest.mark.parametrize("name", ["unicode_normalize", "cover_density_stems"])
def test_texts_go_to_python_in_small_batches(spark, sf, name):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "10000")
    try:
        QUERIES[name](spark, sf)
        assert int(spark.conf.get(setting)) <= 1000
    finally:
        spark.conf.set(setting, before)


def _shuffle_files(spark) -> int:
    return sum("shuffle_" in str(f) for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()))


def test_rounds_of_louvain_leave_no_shuffle_files_behind(spark):
    edges = spark.range(4000).selectExpr("concat('p', id % 500) AS src", "concat('s', (id * 7) % 90) AS tgt")
    before = _shuffle_files(spark)
    found, _ = communities.louvain(edges, rounds=2, levels=2)
    assert _shuffle_files(spark) - before < 40  # those of its few collected sums; tables that it keeps leave none
    assert found.count() == 590
    before = _shuffle_files(spark)
    assert lineage.cut(edges.groupBy("src").count()).count() == 500
    assert _shuffle_files(spark) - before <= 8


def test_reports_read_records_that_are_computed_once(spark, sf):
    plan = QUERIES["extraction_reports"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_kernel_of_exact_search_holds_few_numbers_at_once():
    rng = np.random.default_rng(8)
    x, y = rng.standard_normal((64, 64)), rng.standard_normal((8192, 64))
    index = vector_index.Index("", "l2", np.zeros((1, 64)), np.array([8192]), np.zeros(1), np.zeros((1, 1, 1)), 1)
    left = pa.table({"question": np.arange(64), "vector": list(x)})
    right = pa.table({"id": np.arange(8192), "vector": list(y)})
    tracemalloc.start()
    found = vector_index._best(index, 5, pa.int64(), pa.int64())(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    far = np.sqrt(((x[:1, None] - y[None]) ** 2).sum(2)).round(6)[0]
    assert found.column("id").to_pylist()[:6] == np.lexsort((np.arange(8192), far))[:6].tolist()
