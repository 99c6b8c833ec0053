"""Entity aliases: applying them, reviewing them, guards, canonical relations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_apply(entities: DataFrame, aliases: DataFrame, name: str, least: float) -> DataFrame:
    """entities with the canonical name of their alias, whatever the case."""
    a = aliases.where(F.col("confidence") >= least).select(F.lower("alias").alias("_a"), "canonical")
    return entities.join(a, F.lower(name) == F.col("_a")).drop("_a")


def unreviewed(entities: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """entities that are neither an alias nor a canonical name."""
    out = entities
    for c in ("alias", "canonical"):
        out = out.join(aliases.select(F.lower(c).alias("_a")).distinct(), F.lower(name) == F.col("_a"), "left_anti")
    return out


def to_verify(aliases: DataFrame, low: float, high: float) -> DataFrame:
    return aliases.where(F.col("confidence").between(low, high) & (F.col("verified").isNull() | ~F.col("verified")))


# Types that never name the same thing, and names of months.
INCOMPATIBLE = (
    ("person", "organization"), ("person", "location"), ("person", "event"), ("person", "concept"), ("location", "organization"), ("location", "event"), ("artifact", "technology"), ("concept", "document"), ("document", "event"),
    ("event", "artifact"), ("event", "organization"), ("event", "product"), ("method", "artifact"), ("method", "person"), ("method", "product"), ("organization", "document"), ("organization", "technology"), ("organization", "concept"),
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_UNITS = r"[0-9]+(?:\.[0-9]+)?\s*(?:%|(?:(?i:percent|mg|mcg|ug|g|kg|ml|l|iu|units?|mmol|umol|mol|ng))(?=$|[^A-Za-z0-9_]|[A-Z]))"


def _plain(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def compatible(a: Column, b: Column) -> Column:
    """Whether two types can name the same thing; unknown and empty ones can."""
    a, b = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
    pair = F.concat(F.least(a, b), F.lit("/"), F.greatest(a, b))
    return ~pair.isin(*("/".join(sorted(p)) for p in INCOMPATIBLE))


def calendar_key(name: Column) -> Column:
    """`2024`, `2024 q3` or `2024 05` of a name that is a year, a quarter or a month; else null."""
    x = _plain(name)
    month = F.create_map(*[F.lit(v) for k, m in enumerate(MONTHS, 1) for word in {m, m[:3], *(["sept"] if m == "september" else [])} for v in (word, f"{k:02d}")])
    year = r"((?:19|20)[0-9]{2})"
    forms = ((rf"^(?:q|quarter) ?([1-4]) ?{year}$", 2, 1), (rf"^{year} ?(?:q|quarter) ?([1-4])$", 1, 2))
    out = F.when(x.rlike(f"^{year}$"), x)
    for form, y, q in forms:
        out = out.when(x.rlike(form), F.concat(F.regexp_extract(x, form, y), F.lit(" q"), F.regexp_extract(x, form, q)))
    for form, y, m in ((rf"^([a-z]+) ?{year}$", 2, 1), (rf"^{year} ?([a-z]+)$", 1, 2)):
        found = F.try_element_at(month, F.regexp_extract(x, form, m))
        out = out.when(x.rlike(form) & found.isNotNull(), F.concat(F.regexp_extract(x, form, y), F.lit(" "), found))
    return out


def block_reason(a: Column, b: Column, type_a: Column, type_b: Column) -> Column:
    """Why an alias must not be applied without a look; null if it may.

    Types that exclude each other; different dates; different numbers on both sides; a number on one side alone, in a short code or a dose."""
    numbers = lambda x: F.array_sort(F.array_distinct(F.regexp_extract_all(_plain(x), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1)))
    code = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "").rlike("^[a-z]{2,8}[0-9]+[a-z]?$")
    dose = lambda x: F.translate(x, "µμ", "uu").rlike(r"(?<![A-Za-z0-9_])" + _UNITS)
    na, nb = numbers(a), numbers(b)
    both = (F.size(na) > 0) & (F.size(nb) > 0)
    one = lambda x, own, other: (F.size(own) > 0) & (F.size(other) == 0) & x
    return (
        F.when(~compatible(type_a, type_b), "types")
        .when(~calendar_key(a).eqNullSafe(calendar_key(b)), "dates")
        .when(both & (na != nb), "numbers")
        .when(one(code(a), na, nb) | one(code(b), nb, na), "short code")
        .when(one(dose(a), na, nb) | one(dose(b), nb, na), "dose")
    )


def unresolved(entities: DataFrame, aliases: DataFrame, name: str, latest: str, most: int = 500) -> DataFrame:
    """The latest entities that no alias resolves."""
    known = aliases.select(F.lower("alias").alias("_a")).distinct()
    return entities.join(known, F.lower(name) == F.col("_a"), "left_anti").orderBy(F.desc(latest), name).limit(most)


def expanded(queries: DataFrame, rules: DataFrame, query: str) -> DataFrame:
    """queries with expanded: for each rule (position, canonical, aliases) one of whose names stands in the query as words, the canonical name and its aliases, each once, in the order of rules.

    Queries meet rules by a name's first word."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    names = rules.select("position", F.array_distinct(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_all"))
    each = names.select("position", "_all", F.explode("_all").alias("_n")).withColumn("_n", plain(F.col("_n"))).where("_n <> ''").withColumn("_w", F.split("_n", " ")[0])
    padded = F.concat(F.lit(" "), F.regexp_replace(plain(F.col(query)), "[^a-z0-9 ]", " "), F.lit(" "))
    words = queries.withColumn("_q", padded).select(query, "_q", F.explode(F.array_distinct(F.split(F.trim("_q"), " +"))).alias("_w")).distinct()
    hits = words.join(each, "_w").where(F.contains("_q", F.concat(F.lit(" "), "_n", F.lit(" ")))).select(query, "position", "_all").distinct()
    listed = hits.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("position", "_all"))).alias("_l"))
    return queries.join(listed.select(query, F.array_distinct(F.flatten("_l._all")).alias("expanded")), query, "left").withColumn("expanded", F.coalesce("expanded", F.array().cast("array<string>")))


# Words that tell of a relation between names, and so alone don't name one.
CONTEXTUAL = ("alliance", "alliances", "collaboration", "collaborations", "partner", "partners", "partnership", "partnerships")


def entity_filters(queries: DataFrame, rules: DataFrame, query: str, contextual: Sequence[str] = CONTEXTUAL) -> DataFrame:
    """queries with entity: the canonical name of the first rule (position, canonical, aliases) of which a name stands in the query as words; null if there is none.

    Other names than the canonical one don't count if they hold a contextual word. Queries meet rules by a name's first word."""
    names = rules.select("position", "canonical", F.array_compact(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_all"))
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    alone = lambda n: F.arrays_overlap(F.regexp_extract_all(F.lower(n), F.lit("([a-z0-9]+)"), 1), F.lit(list(contextual)))
    safe = names.withColumn("_all", F.filter("_all", lambda n: (plain(n) == plain(F.col("canonical"))) | ~alone(n)))
    hits = expanded(queries.select(query).distinct(), safe.select("position", F.get("_all", 0).alias("canonical"), F.slice("_all", 2, 10_000).alias("aliases")).where("canonical IS NOT NULL"), query)
    first = hits.where(F.size("expanded") > 0).select(query, F.get("expanded", 0).alias("_first"))
    named = safe.select("position", "canonical", F.get("_all", 0).alias("_first")).where("_first IS NOT NULL").groupBy("_first").agg(F.min_by("canonical", "position").alias("entity"))
    return queries.join(first.join(named, "_first").select(query, "entity"), query, "left")


def canonical_relations(edges: DataFrame, known: Mapping[str, str], rest: str) -> DataFrame:
    """(src, tgt, predicate, n): undirected pairs with their keywords as canonical predicates, loops dropped."""
    words = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    e = edges.where("src <> tgt").select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), F.coalesce(words[F.col("keywords")], F.lit(rest)).alias("predicate"))
    return e.groupBy("src", "tgt", "predicate").agg(F.count("*").alias("n"))
