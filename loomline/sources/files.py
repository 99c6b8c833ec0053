"""Readers and writers of files: folders of texts, question sets, JSON lines, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of files that hold plain text.
TEXT_ENDINGS = ("txt", "md", "csv", "json", "html", "xml", "yaml")


def text_files(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """(path, text) of the text files under a folder whose path isn't in known(path); files that aren't UTF-8 or have no visible character are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*TEXT_ENDINGS))
    if known is not None:
        files = files.join(known.select("path").distinct(), "path", "left_anti")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", text.alias("text")).where(F.col("text").rlike(r"\S"))


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV of questions, gold_chunk_ids split at `;`; lines that begin with # and rows without a question are left out."""
    rows = spark.read.csv(path, header=True, comment="#", multiLine=True, escape='"')
    if "question" not in rows.columns:
        raise ValueError(f"{path} has no column question")
    if "gold_chunk_ids" in rows.columns:
        ids = F.transform(F.split(F.coalesce("gold_chunk_ids", F.lit("")), ";"), lambda x: F.trim(x))
        rows = rows.withColumn("gold_chunk_ids", F.filter(ids, lambda x: x != ""))
    return rows.where(F.trim("question") != "")


def write_json_lines(rows: DataFrame, path: str) -> None:
    """A JSON object a row, without control characters that JSON readers refuse."""
    line = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    rows.select(F.regexp_replace(line, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "").alias("value")).write.text(path)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, kind: str = "csv", vectors: DataFrame | None = None) -> None:
    """nodes, edges and (if given) vectors as CSV with all their columns, as a Markdown table or as lines of text, in folders of their own."""
    tables = {"nodes": nodes, "edges": edges} | ({"vectors": vectors} if vectors is not None else {})
    text = lambda rows: [F.coalesce(F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(c).cast("string"), F.lit("")) for c, t in rows.dtypes]
    for name, rows in tables.items():
        if kind == "csv":
            rows.select(*[x.alias(c) for x, c in zip(text(rows), rows.columns, strict=True)]).write.csv(f"{path}/{name}", header=True)
        elif kind == "md":
            spark = rows.sparkSession
            head = spark.createDataFrame([(f"| {' | '.join(rows.columns)} |",), (f"| {' | '.join('---' for _ in rows.columns)} |",)], "value string").coalesce(1)
            head.write.text(f"{path}/{name}/0-head")
            rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.regexp_replace(x, r"[|\n]", " ") for x in text(rows)]), F.lit(" |")).alias("value")).write.text(f"{path}/{name}/1-rows")
        elif kind == "txt":
            rows.select(F.concat_ws("\t", *text(rows)).alias("value")).write.text(f"{path}/{name}")
        else:
            raise ValueError(f"no such kind of export: {kind}")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of JSON lines; a line that can't be read is tried again without control characters, and left out if it still can't be."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    clean = F.regexp_replace("value", r"[\x00-\x1F]", " ")
    options = {"mode": "FAILFAST"}
    good = lambda c: F.try_parse_json(c).isNotNull()
    text = F.when(good(F.col("value")), F.col("value")).when(good(clean), clean)
    return lines.select(text.alias("t")).where("t IS NOT NULL").select(F.from_json("t", schema, options).alias("x")).select("x.*")


def write_answers(answers: DataFrame, path: str) -> None:
    """Answers (id, text, references, error) as JSON lines that a client reads one by one: a line of references, a line each piece of the text, or one of the error."""
    head = F.when(F.col("error").isNull(), F.to_json(F.struct("id", "references")))
    pieces = F.when(F.col("error").isNull(), F.transform(F.regexp_extract_all("text", F.lit(r"(\S+\s*)"), 1), lambda x: F.to_json(F.struct(F.col("id"), x.alias("response")))))
    lines = F.array_compact(F.concat(F.array(head), F.coalesce(pieces, F.array().cast("array<string>")), F.array(F.when(F.col("error").isNotNull(), F.to_json(F.struct("id", "error"))))))
    answers.select("id", F.posexplode(lines).alias("p", "value")).repartition("id").sortWithinPartitions("id", "p").select("value").write.text(path)
