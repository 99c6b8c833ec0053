"""Merging of entities and relations: attributes by strategies, redirected edges, facts of the same pair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

STRATEGIES = ("concatenate", "keep_first", "keep_last", "join_unique", "join_unique_comma", "max")
#: How entities and relations are merged unless something else is asked for.
ENTITY = {"description": "concatenate", "entity_type": "keep_first", "source_id": "join_unique", "file_path": "join_unique"}
RELATION = {"description": "concatenate", "keywords": "join_unique", "source_id": "join_unique", "file_path": "join_unique", "weight": "max"}


def merged_value(values: Column, strategy: str) -> Column:
    """One value of an array of strings in order, nulls and empty ones left out; null if nothing is left. max gives a double."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    some = F.filter(values, lambda x: x.isNotNull() & (x != ""))
    joined = {
        "concatenate": lambda: F.array_join(some, A.SEPARATOR),
        "keep_first": lambda: F.try_element_at(some, F.lit(1)),
        "keep_last": lambda: F.try_element_at(some, F.lit(-1)),
        "join_unique": lambda: F.array_join(F.array_distinct(F.flatten(F.transform(some, lambda x: F.split(x, A.SEPARATOR)))), A.SEPARATOR),
        "join_unique_comma": lambda: F.array_join(F.array_distinct(F.filter(F.transform(F.flatten(F.transform(some, lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: x != "")), ","),
        "max": lambda: F.array_max(F.transform(some, lambda x: x.try_cast("double"))),
    }[strategy]()
    return F.when(F.size(some) > 0, joined)


def merge_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], strategies: Mapping[str, str]) -> DataFrame:
    """(keys, merged columns, n): the rows of each key as one, their values in the given order."""
    columns = [c for c in rows.columns if c in strategies]
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[F.col(c).cast("string").alias(f"_{c}") for c in columns]))).alias("_l"), F.count("*").alias("n"))
    return listed.select(*keys, *[merged_value(F.col(f"_l._{c}"), strategies[c]).alias(c) for c in columns], "n")


def merge_entities(nodes: DataFrame, edges: DataFrame, into: DataFrame, entity: Mapping[str, str] = ENTITY, relation: Mapping[str, str] = RELATION) -> tuple[DataFrame, DataFrame]:
    """Both tables after the nodes of into (id, canonical) became their canonical one.

    Attributes are merged, the canonical node's own first; edges are redirected, loops go, and those of the same undirected pair become one."""
    named = nodes.join(into, "id", "left").withColumn("_own", F.col("canonical").isNotNull()).withColumn("id_", F.coalesce("canonical", "id"))
    merged = merge_rows(named.select("id_", "_own", F.col("id").alias("_id"), *[c for c in nodes.columns if c != "id"]), ["id_"], ["_own", "_id"], entity)
    a = into.select(F.col("id").alias("src"), F.col("canonical").alias("_a"))
    b = into.select(F.col("id").alias("tgt"), F.col("canonical").alias("_b"))
    moved = edges.join(a, "src", "left").join(b, "tgt", "left").withColumn("s", F.coalesce("_a", "src")).withColumn("t", F.coalesce("_b", "tgt")).where("s <> t")
    pairs = moved.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), F.col("src").alias("_src"), F.col("tgt").alias("_tgt"), *[c for c in edges.columns if c not in ("src", "tgt")])
    one = merge_rows(pairs, ["a", "b"], ["_src", "_tgt"], relation)
    return merged.withColumnRenamed("id_", "id"), one.withColumnRenamed("a", "src").withColumnRenamed("b", "tgt")


def merge_facts(facts: DataFrame, order: Sequence[str]) -> DataFrame:
    """(src, tgt, weight, keywords, description, n): facts of the same undirected pair; weights summed, keywords as a set, descriptions joined."""
    pairs = facts.where("src <> tgt").select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), "weight", "keywords", "description", *order)
    listed = F.array_sort(F.collect_list(F.struct(*order, "keywords", "description")))
    out = pairs.groupBy("src", "tgt").agg(F.sum("weight").alias("weight"), listed.alias("_l"), F.count("*").alias("n"))
    return out.select("src", "tgt", "weight", merged_value(F.col("_l.keywords"), "join_unique_comma").alias("keywords"), merged_value(F.array_distinct("_l.description"), "concatenate").alias("description"), "n")


def conflicting(facts: DataFrame, polarity: str) -> DataFrame:
    """(src, tgt): undirected pairs whose facts point both ways."""
    pairs = facts.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), F.col(polarity).alias("_p"))
    return pairs.groupBy("src", "tgt").agg(F.count_if(F.col("_p") == "affirmative").alias("_y"), F.count_if(F.col("_p") != "affirmative").alias("_n")).where("_y > 0 AND _n > 0").select("src", "tgt")


def rename(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with nodes renamed by names (id, new). A new name that another node has is refused: its rows keep the old one."""
    free = names.join(nodes.select(F.col("id").alias("new")), "new", "left_anti").groupBy("new").agg(F.min("id").alias("id"))
    out = nodes.join(free, "id", "left").withColumn("id", F.coalesce("new", "id")).drop("new")
    for end in ("src", "tgt"):
        edges = edges.join(free.select(F.col("id").alias(end), "new"), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
    return out, edges


def audit_rows(into: DataFrame, method: str = "manual_merge") -> DataFrame:
    """(alias, canonical, method, confidence): what a merge leaves in the table of aliases."""
    return into.where("id <> canonical").select(F.col("id").alias("alias"), "canonical", F.lit(method).alias("method"), F.lit(1.0).alias("confidence")).distinct()


def resolvable(aliases: DataFrame, edges: DataFrame) -> DataFrame:
    """aliases (alias, canonical) without those that would turn an edge into a loop."""
    both = edges.select("src", "tgt").unionByName(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")))
    return aliases.join(both, (F.col("alias") == F.col("src")) & (F.col("canonical") == F.col("tgt")), "left_anti")
