"""Readers, writers and streams by round trips and against the same query on the whole table."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomline.operators import documents
from loomline.sources import files
from loomline.streaming import rollups


def test_text_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.txt", b"one"), ("b.md", "zwei ü".encode()), ("c.bin", b"no"), ("d.txt", b"\xff\xfe"), ("e.txt", b" \n")):
        (tmp_path / "in" / name).write_bytes(data)
    got = files.text_files(spark, str(tmp_path / "in"))
    assert sorted(r.text for r in got.collect()) == ["one", "zwei ü"]
    assert [r.text for r in files.text_files(spark, str(tmp_path / "in"), got.where("text = 'one'")).collect()] == ["zwei ü"]


def test_question_set(spark, tmp_path):
    (tmp_path / "q.csv").write_text('question,gold_chunk_ids\n# no\n"a, b?",c1; c2;\nd?,\n,c3\n')
    assert [(r.question, r.gold_chunk_ids) for r in files.question_set(spark, str(tmp_path / "q.csv")).collect()] == [("a, b?", ["c1", "c2"]), ("d?", [])]
    (tmp_path / "bad.csv").write_text("x\n1\n")
    with pytest.raises(ValueError, match="question"):
        files.question_set(spark, str(tmp_path / "bad.csv"))


def test_writers(spark, tmp_path):
    files.write_json_lines(spark.createDataFrame([(1, 'a"b'), (2, None)], "id long, text string").coalesce(1), str(tmp_path / "j"))
    lines = [json.loads(x) for f in (tmp_path / "j").glob("part-*") for x in f.read_text().splitlines()]
    assert lines == [{"id": 1, "text": 'a"b'}, {"id": 2, "text": None}]
    nodes = spark.createDataFrame([("n", "t", None, 2.5)], "name string, type string, description string, weight double")
    edges, vectors = spark.createDataFrame([("n", "m", "a|d")], "src string, tgt string, description string"), spark.createDataFrame([("n", [1.0, 2.0])], "name string, vector array<double>")
    for kind in ("csv", "md", "txt"):
        files.export_graph(nodes, edges, str(tmp_path / kind), kind, vectors)
    assert [r.value for r in spark.read.text(str(tmp_path / "txt" / "edges")).collect()] == ["n\tm\ta|d"]
    assert [r.value for r in spark.read.text(str(tmp_path / "md" / "edges" / "1-rows")).collect()] == ["| n | m | a d |"]
    assert [r.vector for r in spark.read.csv(str(tmp_path / "csv" / "vectors"), header=True).collect()] == ["[1.0,2.0]"]
    with pytest.raises(ValueError, match="kind"):
        files.export_graph(nodes, edges, str(tmp_path / "x"), "xls")


def test_rows_in_batches(spark, tmp_path):
    documents.in_batches(spark.range(1200).coalesce(1), str(tmp_path / "b"), 500)
    documents.in_batches(spark.range(1200, 1300).coalesce(1), str(tmp_path / "b"), 500)
    assert sorted(spark.read.parquet(str(f)).count() for f in (tmp_path / "b").glob("*.parquet")) == [100, 200, 500, 500]


def test_a_workspace_is_read_alone(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "workspace string, id int")
    rows.write.partitionBy("workspace").parquet(str(tmp_path / "w"))
    mine = spark.read.parquet(str(tmp_path / "w")).where(F.col("workspace") == "a")
    assert sorted(r.id for r in mine.collect()) == [1, 3] and len(mine.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(workspace" in mine._jdf.queryExecution().toString()


def test_json_lines_are_read(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"id": 1, "t": "a"}\n{"id": 2, "t": "b\x01c"}\nbroken\n\n{"id": 3}\n')
    assert [tuple(r) for r in files.read_json(spark, str(tmp_path / "j.jsonl"), "id int, t string").orderBy("id").collect()] == [(1, "a"), (2, "b c"), (3, None)]


def test_answers_as_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "so it is", ["r1"], None), (2, None, None, "failed")], "id int, text string, references array<string>, error string")
    files.write_answers(rows, str(tmp_path / "a"))
    lines = [json.loads(x) for f in sorted((tmp_path / "a").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x for x in lines if x["id"] == 1] == [{"id": 1, "references": ["r1"]}, {"id": 1, "response": "so "}, {"id": 1, "response": "it "}, {"id": 1, "response": "is"}]
    assert [x for x in lines if x["id"] == 2] == [{"id": 2, "error": "failed"}]


def test_documents_are_processed_again(spark, tmp_path):
    chunk = lambda df: df.select("doc_id", F.posexplode(F.split("text", " ")).alias("p", "word"))
    words = lambda: sorted((r.doc_id, r.word) for r in rollups.current(spark, str(tmp_path / "out")).collect())
    assert rollups.current(spark, str(tmp_path / "out")) is None
    for rows in ([(1, "a b"), (2, "c")], [(1, "d"), (3, "e f")]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rollups.reprocess(rollups.table_stream(spark, str(tmp_path / "in")), chunk, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert words() == [(1, "d"), (2, "c"), (3, "e"), (3, "f")]
    rollups.reprocess(rollups.table_stream(spark, str(tmp_path / "in")), chunk, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert words() == [(1, "d"), (2, "c"), (3, "e"), (3, "f")]


def test_rolling_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = rollups.rolling_rollup(rollups.table_stream(spark, str(tmp_path / "in")), late="60 days")
    stream.writeStream.format("memory").queryName("rolling").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    want = rollups.rolling_rollup(events)
    rounded = lambda df: sorted((str(r.window_start), r.event_type, r.n, round(r.mean, 6)) for r in df.collect())
    assert rounded(spark.table("rolling")) == rounded(want)


def test_rollup_of_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.orderBy("ts").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = rollups.event_rollup(rollups.table_stream(spark, str(tmp_path / "in")), late="60 days")
    query = stream.writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = rollups.event_rollup(events)
    rounded = lambda df: sorted((str(r.window_start), r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert rounded(spark.table("rolled")) == rounded(want)


def test_first_of_key_goes_on(spark, tmp_path):
    row = lambda i, k: spark.range(1).select(F.lit(k).alias("k"), F.expr(f"timestamp'2024-01-0{i} 00:00:00'").alias("ts"))
    for i, k in ((1, "a"), (1, "a"), (2, "b")):
        row(i, k).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        rows = rollups.first_of_key(rollups.table_stream(spark, str(tmp_path / "in")), "k", "ts", late="9 days")
        rollups.write_all(rows, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
