"""Document and key-value tables: upserts, deletes, lookups, status, paging, bookkeeping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: Sequence[str] = (), keep_if_null: Sequence[str] = ()) -> DataFrame:
    """old with the rows of new laid over it. keep_old: columns that an existing row keeps; keep_if_null: those it keeps where the new value is null."""
    columns = [c for c in old.columns if c != key]
    both = old.select(key, F.lit(True).alias("_there"), *(F.col(c).alias(f"_o_{c}") for c in columns)).join(new.select(key, F.lit(True).alias("_comes"), *(F.col(c).alias(f"_n_{c}") for c in columns)), key, "full")

    def value(c: str) -> Column:
        o, n = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if c in keep_old:
            return F.when(F.col("_there"), o).otherwise(n)
        if c in keep_if_null:
            return F.coalesce(n, o)
        return F.when(F.col("_comes"), n).otherwise(o)

    return both.select(key, *(value(c).alias(c) for c in columns))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def absent(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return keys.join(table, key, "left_anti")


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def get_in_order(ids: DataFrame, table: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """One row for each asked id, in order of position, with nulls where the table lacks it."""
    return ids.join(table, key, "left").orderBy(position)


def canonical_by_content(docs: DataFrame, content: str, path: str, order: Sequence[Column]) -> DataFrame:
    """(id, path, copies): one row for each distinct content, with its least path by the given order."""
    return docs.groupBy(A.content_id("doc", F.col(content)).alias("id")).agg(F.min_by(path, F.struct(*order)).alias(path), F.count("*").alias("copies"))


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    """(status, n) with a row `all` for the total."""
    return rows.rollup(status).agg(F.count("*").alias("n"), F.grouping(status).alias("_g")).select(F.when(F.col("_g") == 1, "all").otherwise(F.col(status)).alias(status), "n")


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """A page of rows with the total of all; an empty page is one row of nulls with the total. Sizes are held to 10..200."""
    size = min(max(size, 10), 200)
    part = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.agg(F.count("*").alias("total")).join(part, F.lit(True), "left")


def where_all(rows: DataFrame, conditions: Sequence[Column | None]) -> DataFrame:
    """rows that meet all conditions that are given."""
    for c in conditions:
        if c is not None:
            rows = rows.where(c)
    return rows


def mismatched(docs: DataFrame, chunks: DataFrame, doc: str, stored: str) -> DataFrame:
    """(doc, stored, actual) where the stored number of chunks is not the actual one (nulls count as values)."""
    counts = chunks.groupBy(doc).agg(F.count("*").alias("actual"))
    return docs.join(counts, doc, "left").where(~F.col(stored).eqNullSafe(F.col("actual"))).select(doc, stored, "actual")


def rebuild_plan(items: DataFrame, gone: DataFrame, key: str, sources: str = "sources") -> DataFrame:
    """items with what is left of their source ids, in order, once those of gone (id) are deleted, and action: delete, rebuild or keep.

    Source ids meet the deleted ones by a join, however many there are of either."""
    each = items.select(key, F.posexplode(sources).alias("_p", "id")).join(gone.select("id").distinct(), "id", "left_anti")
    kept = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", "id"))).alias("_l")).select(key, F.col("_l.id").alias("remaining"))
    left = items.join(kept, key, "left").withColumn("remaining", F.coalesce("remaining", F.array().cast("array<string>")))
    return left.withColumn("action", F.when(F.size("remaining") == 0, "delete").when(F.size("remaining") < F.size(sources), "rebuild").otherwise("keep"))


def split_new(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """incoming with is_new: whether the key is not known yet."""
    return incoming.join(known.select(key).distinct().withColumn("_k", F.lit(True)), key, "left").withColumn("is_new", F.col("_k").isNull()).drop("_k")


def sql_rows(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], **args) -> DataFrame:
    """Rows of a parametrised SQL query over named tables; args stand for :name in it."""
    return spark.sql(sql, args=args, **tables) if args else spark.sql(sql, **tables)


def in_batches(rows: DataFrame, path: str, size: int, mode: str = "append") -> None:
    """Write rows, at most so many a file."""
    rows.write.mode(mode).option("maxRecordsPerFile", size).parquet(path)


def vectors_of(table: DataFrame, ids: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) of the asked ids that the table has a vector for."""
    return table.where(F.col(vector).isNotNull()).select(key, vector).join(ids.select(key).distinct(), key, "left_semi")


def without_vector(table: DataFrame, ids: DataFrame, key: str, vector: str) -> DataFrame:
    """The rows of the asked ids, all columns but the vector."""
    return table.drop(vector).join(ids.select(key).distinct(), key, "left_semi")


def chunks_of(chunks: DataFrame, docs: DataFrame, doc: str, order: str, chunk: str) -> DataFrame:
    """(doc, ids): the chunk ids of each asked document, in order, chunks without a place last."""
    place = F.struct(F.col(order).isNull(), order, chunk)
    listed = chunks.join(docs.select(doc).distinct(), doc, "left_semi").groupBy(doc).agg(F.array_sort(F.collect_list(place)).alias("_l"))
    return listed.select(doc, F.col(f"_l.{chunk}").alias("ids"))


def without_name(relations: DataFrame, name: str) -> DataFrame:
    """Relations of which neither end has the name."""
    return relations.where((F.col("src") != name) & (F.col("tgt") != name))


def empty(tables: Mapping[str, DataFrame]) -> dict[str, bool]:
    """Whether each table has no row; each is read up to its first."""
    return {name: t.isEmpty() for name, t in tables.items()}


def backfilled(table: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """table whose column is filled from values (key, value) where it is null or empty."""
    missing = F.col(column).isNull() | (F.trim(column) == "")
    return table.join(values.select(key, F.col("value").alias("_v")), key, "left").withColumn(column, F.when(missing, F.coalesce("_v", column)).otherwise(F.col(column))).drop("_v")


def missing(table: DataFrame, column: str, status: str, done: str) -> DataFrame:
    """Rows of a status, whatever its case, whose column is null or empty."""
    return table.where((F.lower(status) == done.lower()) & (F.col(column).isNull() | (F.trim(column) == "")))


def columns_of(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, position, column_name, kind) of each table."""
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, df in tables.items() for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, kind string")


def browse(table: DataFrame, number: int, size: int) -> DataFrame:
    """A page of any table with the total, newest first if it has a time, else by its id or first column."""
    names = {c.lower(): c for c in table.columns}
    newest = next((names[c] for c in ("update_time", "updated_at", "create_time", "created_at") if c in names), None)
    order = [F.desc_nulls_last(newest)] if newest else []
    return page(table, [*order, F.asc(names.get("id", table.columns[0]))], number, size)


def cache_pages(cache: DataFrame, prefix: str, after: str | None, size: int, key: str = "id") -> DataFrame:
    """The next entries of a cache whose key begins so, behind the last that was seen."""
    rows = cache.where(F.col(key).startswith(prefix))
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(size)


def without_prefixes(cache: DataFrame, prefixes: Sequence[str], key: str = "id") -> DataFrame:
    gone = F.lit(False)
    for p in prefixes:
        gone = gone | F.col(key).startswith(p)
    return cache.where(~gone)


def with_metadata(vectors: DataFrame, metadata: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vector rows with the metadata of their chunk, where there is any."""
    return vectors.join(metadata, list(keys), "left")


def orphans(docs: DataFrame, parts: Mapping[str, DataFrame], doc: str, status: str) -> DataFrame:
    """Documents that a part lacks, with how many rows each part has of them."""
    out = docs.select(doc, status)
    for name, part in parts.items():
        out = out.join(part.groupBy(doc).agg(F.count("*").alias(name)), doc, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    lacking = F.lit(False)
    for name in parts:
        lacking = lacking | (F.col(name) == 0)
    return out.where(lacking)


def key_conflicts(rows: DataFrame, key: str, derived: Column) -> DataFrame:
    """Rows whose derived key another row already has as its key."""
    return rows.withColumn("_d", derived).join(rows.select(F.col(key).alias("_k")), F.col("_d") == F.col("_k")).where(F.col(key) != F.col("_d")).drop("_k").withColumnRenamed("_d", "derived")


def linked_chunks(items: DataFrame, chunk_ids: str, item: str, chunks: DataFrame, chunk: str) -> DataFrame:
    """(chunk, occurrences, items): the chunks that ranked items (with `rank`) are drawn from, how many items share each, the best item first.

    An item's chunk ids are an array."""
    each = items.select(item, "rank", F.explode(F.array_distinct(chunk_ids)).alias(chunk))
    found = each.join(chunks.select(chunk).distinct(), chunk, "left_semi").groupBy(chunk).agg(F.count("*").alias("occurrences"), F.min_by(item, F.struct("rank", item)).alias("best"), F.min("rank").alias("rank"))
    return found


def chunk_tracking(items: DataFrame, key: str, source_id: str = "source_id", separator: str = A.SEPARATOR) -> DataFrame:
    """(key, chunk_ids, n) from joined source ids, without blanks and repeats."""
    ids = F.array_distinct(F.filter(F.transform(F.split(source_id, separator), lambda x: F.trim(x)), lambda x: x != ""))
    return items.select(key, ids.alias("chunk_ids"), F.size(ids).alias("n"))


def with_cache_keys(chunks: DataFrame, used: DataFrame, chunk: str, column: str = "cache_keys") -> DataFrame:
    """chunks whose list of cache keys has those of used (chunk, cache_key) behind its own, each once."""
    new = used.groupBy(chunk).agg(F.array_sort(F.collect_set("cache_key")).alias("_n"))
    none = F.array().cast("array<string>")
    return chunks.join(new, chunk, "left").withColumn(column, F.array_distinct(F.concat(F.coalesce(column, none), F.coalesce("_n", none)))).drop("_n")


def failed(files: DataFrame, path: str, error: str, id_prefix: str = "error") -> DataFrame:
    """Status rows for files that could not be read."""
    return files.select(A.content_id(id_prefix, F.concat_ws("|", path, error)).alias("id"), F.col(path).alias("file_path"), F.lit("failed").alias("status"), F.col(error).alias("error_msg"), F.lit(0).alias("chunks_count"))


def typed(nodes: DataFrame, types: DataFrame, key: str, column: str, unknown: str = "unknown") -> DataFrame:
    """nodes whose unknown type is set from types (key, type)."""
    lost = F.col(column).isNull() | (F.lower(F.trim(column)) == unknown) | (F.trim(column) == "")
    return nodes.join(types.select(key, F.col("type").alias("_t")), key, "left").withColumn(column, F.when(lost, F.coalesce("_t", column)).otherwise(F.col(column))).drop("_t")


_NAME = r"[\\/]+"


def canonical_order(path: Column, generic: str = r"^(?:processed|document|file|test_doc[0-9]*)$") -> Column:
    """What the best of several paths of one content is least by: known before unknown, named before placeholders, fewest marks of a copy, fewest folders, the shortest name, then the name and the path."""
    p = F.trim(F.coalesce(path, F.lit("")))
    leaf = F.element_at(F.split(p, _NAME), -1)
    stem = F.regexp_replace(leaf, r"\.[^.]*$", "")
    copies = F.regexp_extract(stem, r"((?:_[0-9]{1,3})+)$", 1)
    return F.struct(
        ((p == "") | (p == "unknown_source")).cast("int").alias("a"), F.lower(F.regexp_replace(stem, r"(?:_[0-9]{1,3})+$", "")).rlike(generic).cast("int").alias("b"), (F.size(F.split(copies, "_", -1)) - 1).alias("c"),
        F.size(F.filter(F.split(p, _NAME), lambda x: x != "")).alias("d"), F.length(leaf).alias("e"), F.lower(leaf).alias("f"), F.lower(p).alias("g"),
    )


def import_graph(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of a custom graph: chunks with ids of their content, entities with those that only relations name (of type UNKNOWN), relations without loops.

    chunks (source, content), entities (id, entity_type, description, source), relations (src, tgt, description, keywords, weight, source); a source that no chunk has becomes UNKNOWN."""
    made = chunks.select(A.content_id("chunk", F.col("content")).alias("chunk_id"), "source", "content").dropDuplicates(["chunk_id"])
    ids = made.groupBy("source").agg(F.min("chunk_id").alias("source_id"))
    with_id = lambda df: df.join(ids, "source", "left").withColumn("source_id", F.coalesce("source_id", F.lit("UNKNOWN"))).drop("source")
    edges = with_id(relations.where("src <> tgt"))
    ends = edges.select(F.col("src").alias("id"), "source_id").unionByName(edges.select(F.col("tgt").alias("id"), "source_id")).groupBy("id").agg(F.min("source_id").alias("source_id"))
    lacking = ends.join(entities.select("id"), "id", "left_anti").select("id", F.lit("UNKNOWN").alias("entity_type"), F.lit("UNKNOWN").alias("description"), "source_id")
    return made, with_id(entities).select("id", "entity_type", "description", "source_id").unionByName(lacking), edges
