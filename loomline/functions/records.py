"""Extraction records: lines of fields with a delimiter, names, types, relations and the texts that they are searched by."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITER = "<|#|>"
# Types of entities, words for them, and phrases of relations.
ENTITY_TYPES = ("Person", "Organization", "Location", "Event", "Concept", "Method", "Technology", "Product", "Document", "Data", "Artifact")
TYPE_ALIASES = {
    "activity": "event", "animal": "concept", "batch": "artifact", "date": "data", "dose": "data", "group": "organization", "other": "concept", "people": "person", "process": "method", "project": "event", "role": "person",
    "stage": "event", "study": "document", "task": "method", "team": "organization", "time": "data", "unknown": "concept", "workstream": "organization",
}
IMPACT_PHRASES = (
    "affect", "affected", "affects", "can pose risk", "can pose risks", "cause", "caused", "causes", "consequence", "consequences", "due to", "impact", "impacted", "impacts", "influence", "influenced", "influences",
    "led to", "leads to", "outcome", "outcomes", "pose risk", "pose risks", "poses risk", "poses risks", "risk to", "risks to", "resulted in", "resulting in", "results in",
)
NEGATIVE_PHRASES = (
    "does not support", "insufficient evidence", "lack of evidence", "lacked evidence", "lacking evidence", "lacks evidence", "limited evidence", "no association", "no evidence", "no stringent evidence", "not associated",
    "not support", "without evidence",
)
HINT_STOPWORDS = ("and", "for", "from", "into", "onto", "the", "to", "with")
SWAPPED = {"represented by": "represents", "is represented by": "represents", "was represented by": "represents", "were represented by": "represents"}
_CJK = r"一-龥"
_LATIN = r"a-zA-Z0-9()\[\]@#$%!&*\-=+_"


# Broken forms of a delimiter, in the order in which they are mended; CORE stands for its core.
BROKEN_FORMS = (
    r"<\|CORE\|*?CORE\|>",
    r"<\|\\CORE\|>",
    r"<\|+>",
    r"<[^\n]?\|CORE\|[^\n]?>",
    r"<\|?CORE\|?>",
    r"<[^|]CORE\|>|<\|CORE[^|]>",
    r"<\|CORE\|+(?!>)",
    r"<\|CORE:(?!>)",
    r"<\|+CORE>",
    r"<\|\|(?!>)",
    r"(?<!<)\|CORE\|>",
    r"<\|CORE\|>\|",
    r"\|\|CORE\|\|",
)


def repaired(record: Column, core: str = "#", delimiter: str = DELIMITER) -> Column:
    """A record whose delimiters are whole again, each broken form mended after the one before it. Without a core or a delimiter it stays as it is."""
    if not core or not delimiter:
        return record
    whole = F.lit(delimiter.replace("\\", r"\\").replace("$", r"\$"))
    for form in BROKEN_FORMS:
        record = F.regexp_replace(record, form.replace("CORE", re.escape(core)), whole)
    return record


def fields(record: Column, delimiter: str = DELIMITER) -> Column:
    return F.transform(F.split(record, re.escape(delimiter), -1), lambda x: F.trim(x))


def split_at(text: Column, markers: Sequence[str]) -> Column:
    """The parts between any of the markers, trimmed, without empty ones."""
    parts = F.split(F.coalesce(text, F.lit("")), "|".join(map(re.escape, markers)), -1) if markers else F.array(F.coalesce(text, F.lit("")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def is_float(text: Column) -> Column:
    return text.rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def normalized_name(name: Column, inner_quotes: bool = False) -> Column:
    """A name without line and paragraph tags, full-width letters and signs as plain ones, no spaces around Chinese characters, no outer quotes.

    Empty where only a short number is left. inner_quotes: typographic quotes and those beside Chinese characters go too."""
    # most names are plain ASCII from a letter on, without quotes and tags, which none of the steps changes
    plain = name.rlike(r"^[a-zA-Z](?:[\x20-\x7e&&[^\"'<>]]*[\x21-\x7e&&[^\"'<>]])?\z")
    x = F.regexp_replace(name, r"(?i)</?(?:p|br)\s*/?>", "")
    wide = "".join(map(chr, [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0xFF10, 0xFF1A)])) + "－＋／＊（）—　"
    x = F.translate(x, wide, "".join(chr(ord(c) - 0xFEE0) for c in wide[:62]) + "-+/*()- ")
    x = F.regexp_replace(x, rf"(?<=[{_CJK}])\s+(?=[{_CJK}{_LATIN}])|(?<=[{_LATIN}])\s+(?=[{_CJK}])", "")
    for a, b in (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("《", "》")):
        x = F.regexp_replace(x, f"^{a}([^{a}{b}]*){b}$", "$1")
    if inner_quotes:
        x = F.regexp_replace(x, rf"[“”‘’]|['\"]+(?=[{_CJK}])|(?<=[{_CJK}])['\"]+", "")
        x = F.regexp_replace(F.regexp_replace(x, " ", " "), "(?<=[^0-9]) ", " ")
    short = lambda x: ((F.length(x) < 3) & x.rlike("^[0-9]+$")) | ((F.length(x) < 6) & x.rlike(r"^[0-9.]*\.[0-9.]*$"))
    # over an array, so that the steps are taken once
    return F.when(plain, name).otherwise(F.get(F.transform(F.array(F.trim(x)), lambda x: F.when(short(x), "").otherwise(x)), 0))


def entity_type(raw: Column, allowed: Sequence[str] = ENTITY_TYPES, aliases: Mapping[str, str] = TYPE_ALIASES) -> Column:
    """The allowed type that a word names, itself or by an alias; else concept, data, document or the first that is allowed."""
    known = list(dict.fromkeys(t.replace(" ", "").lower() for t in allowed))
    rest = next((t for t in ("concept", "data", "document") if t in known), known[0] if known else "concept")
    plain = F.lower(F.replace(raw, F.lit(" "), F.lit("")))
    names = F.create_map(*[F.lit(x) for kv in ({k: v for k, v in aliases.items() if v in known} | {t: t for t in known}).items() for x in kv])
    return F.coalesce(F.try_element_at(names, plain), F.lit(rest))


def entity_records(rows: DataFrame, record: str, keep: Sequence[str]) -> DataFrame:
    """(keep, name, type, description) of the rows whose record has four fields, none of them empty, and a type without signs.

    The fields are generated columns, so that each is computed once."""
    f = F.col("_f")
    four = rows.select(*keep, fields(F.col(record)).alias("_f")).where((F.size(f) == 4) & F.contains(F.get(f, 0), F.lit("entity")))
    named = F.struct(normalized_name(F.get(f, 1), True).alias("name"), normalized_name(F.get(f, 2), True).alias("_kind"), normalized_name(F.get(f, 3)).alias("description"))
    good = four.select(*keep, F.inline(F.array(named))).where("name <> '' AND _kind <> '' AND description <> ''").where(~F.col("_kind").rlike(r"['()<>|/\\]"))
    return good.select(*keep, "name", entity_type(F.col("_kind")).alias("type"), "description")


def relation_records(rows: DataFrame, record: str, keep: Sequence[str], canonical: Mapping[str, str]) -> DataFrame:
    """(keep, src, tgt, keywords array, description, weight) of the rows whose record has five fields and two different ends.

    Keywords that only say the reverse of a relation swap its ends."""
    def named(f: Column) -> Column:
        last = F.regexp_replace(F.get(f, 4), "^[\"']+|[\"']+$", "")
        return F.struct(normalized_name(F.get(f, 1), True).alias("_a"), normalized_name(F.get(f, 2), True).alias("_b"), cleaned_keyword(F.get(f, 3)).alias("_k"), normalized_name(F.get(f, 4)).alias("description"), last.alias("_w"))

    # over an array, so that a record is cut once
    five = F.filter(F.array(fields(F.col(record))), lambda f: (F.size(f) == 5) & F.contains(F.get(f, 0), F.lit("relation")))
    good = rows.select(*keep, F.inline(F.transform(five, named))).where("_a <> '' AND _b <> '' AND _a <> _b")
    swap = F.col("_k").isin(*SWAPPED)
    weight = F.when(is_float(F.col("_w")), F.col("_w").cast("double")).otherwise(1.0)
    terms = predicates(F.array(F.when(swap, "represents").otherwise(F.col("_k"))), canonical)
    return good.select(*keep, F.when(swap, F.col("_b")).otherwise(F.col("_a")).alias("src"), F.when(swap, F.col("_a")).otherwise(F.col("_b")).alias("tgt"), terms.alias("keywords"), "description", weight.alias("weight"))


def malformed(record: Column) -> Column:
    """Why a record can't be read: its number of fields for its kind, an unknown kind; null if it can."""
    f = fields(record)
    kind = F.lower(F.get(f, 0))
    return F.when(F.contains(kind, F.lit("entity")), F.when(F.size(f) != 4, F.concat(F.lit("entity with "), F.size(f).cast("string"), F.lit(" fields")))).when(
        F.contains(kind, F.lit("relation")), F.when(F.size(f) != 5, F.concat(F.lit("relation with "), F.size(f).cast("string"), F.lit(" fields")))
    ).otherwise("unknown kind")


def _clean(keyword: Column) -> Column:
    """Whether a keyword is plain ASCII that cleaning does not change."""
    return keyword.rlike(r"^[\x21-\x7e&&[^A-Z,.;\\]][\x20-\x7e&&[^A-Z,.;\\]]*\z") & ~F.contains(keyword, F.lit("  ")) & ~keyword.endswith(" ")


def cleaned_keyword(keyword: Column) -> Column:
    x = F.regexp_replace(F.replace(keyword, F.lit("，"), F.lit(",")), r"\s+", " ")
    return F.when(_clean(keyword), keyword).otherwise(F.lower(F.replace(F.regexp_replace(x, r"^[ \t\r\n,.;]+|[ \t\r\n,.;]+$", ""), F.lit("\\,"), F.lit(","))))


def predicates(keywords: Column, canonical: Mapping[str, str], most: int = 3) -> Column:
    """Canonical relation terms of an array of keywords, at most so many, each once.

    A keyword is cut at commas; of one joined by `and`, or else by `then`, the first part counts, and the second if it is a canonical term."""
    known = F.create_map(*[F.lit(x) for kv in canonical.items() for x in kv]) if canonical else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    named = lambda x: F.coalesce(F.try_element_at(known, x), x)
    values = sorted(set(canonical.values()))

    def parts(x: Column) -> Column:
        two = F.transform(F.transform(F.when(F.contains(x, F.lit(" and ")), F.split(x, " and ", 2)).otherwise(F.split(x, " then ", 2)), cleaned_keyword), named)
        return F.filter(two, lambda y, i: (y != "") & ((i == 0) | y.isin(*values)))

    # step by step over arrays, so that each value is computed once
    keys = F.transform(F.transform(keywords, cleaned_keyword), named)
    each = F.transform(F.flatten(F.transform(keys, lambda k: F.split(k, ","))), cleaned_keyword)
    return F.slice(F.array_distinct(F.flatten(F.transform(F.transform(F.filter(each, lambda x: x != ""), named), parts))), 1, most)


def _has_phrase(text: Column, phrases: Sequence[str]) -> Column:
    return text.rlike(r"(?:^|[^a-z0-9])(?:" + "|".join(map(re.escape, phrases)) + r")(?:$|[^a-z0-9])")


def semantics(keywords: Column, text: Column) -> Column:
    """struct<polarity, facets>: whether a relation is affirmed, and whether it is about impact or evidence."""
    low = F.lower(F.concat_ws(" ", keywords, text))
    impact, negative = _has_phrase(low, IMPACT_PHRASES), _has_phrase(low, NEGATIVE_PHRASES)
    weak = F.contains(low, F.lit("insufficient evidence")) | F.contains(low, F.lit("limited evidence"))
    polarity = F.when(~negative, "affirmative").when(weak, "insufficient_evidence").otherwise("negative_evidence")
    none = F.array().cast("array<string>")
    facets = F.concat(F.when(impact, F.array(F.lit("consequence"))).otherwise(none), F.when(negative, F.array(F.lit("evidence"))).otherwise(none), F.when(impact, F.array(F.lit("impact"))).otherwise(none))
    return F.struct(polarity.alias("polarity"), facets.alias("facets"))


def semantic_hints(keywords: Column, text: Column, rules: Sequence[tuple[Sequence[str], str]] = ()) -> Column:
    """What a relation is also searched by: the hints of impact and of missing evidence, and those of the rules (phrases, hint) one of whose phrases it holds, each once, in order."""
    low = F.lower(F.concat_ws(" ", keywords, text))
    # The two hints.
    every = [(IMPACT_PHRASES, "impact consequence effect result outcome"), (NEGATIVE_PHRASES, "negative evidence no evidence insufficient evidence not supported"), *rules]

    def holds(phrases: Sequence[str]) -> Column:
        words = [p for p in phrases if " " not in p]
        found = low.rlike(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b") if words else F.lit(False)
        for p in phrases:
            if " " in p:
                found = found | F.contains(low, F.lit(p))
        return found

    return F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(holds(phrases), hint) for phrases, hint in every]))), "; ")


def search_hints(src: Column, tgt: Column, keywords: Column, text: Column, most: int = 24) -> Column:
    """Distinct words of a relation, of three letters or more and no stop words, keywords first."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", keywords, src, tgt, text)), F.lit("([a-z0-9]+)"), 1)
    return F.array_join(F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*HINT_STOPWORDS))), 1, most), " ")


def relation_text(src: Column, tgt: Column, keywords: Column, description: Column, primary: Column) -> Column:
    """The text by which a relation is searched: its parts, the sentence of its triple, what it is about and hints."""
    s = semantics(keywords, description)
    lines = [F.concat(keywords, F.lit("\t"), src), tgt, description, F.concat(F.lit("relation: "), src, F.lit(" --"), primary, F.lit("--> "), tgt), F.concat(F.lit("source_entity: "), src), F.concat(F.lit("target_entity: "), tgt), F.concat(F.lit("predicate: "), primary)]
    lines.append(F.when(s.polarity != "affirmative", F.concat(F.lit("polarity: "), s.polarity)))
    lines.append(F.when(F.size(s.facets) > 0, F.concat(F.lit("facets: "), F.array_join(s.facets, ", "))))
    lines.append(F.concat(F.lit("search_hints: "), search_hints(src, tgt, keywords, description)))
    return F.concat_ws("\n", *lines)


def parsed_relation_text(content: Column) -> Column:
    """struct<keywords, src, tgt, description> of the first lines of a relation's text."""
    lines = F.split(content, "\n", -1)
    head = F.split(F.get(lines, 0), "\t", 2)
    return F.struct(F.get(head, 0).alias("keywords"), F.get(head, 1).alias("src"), F.get(lines, 1).alias("tgt"), F.get(lines, 2).alias("description"))


def type_in_content(content: Column) -> Column:
    """The type that the second line of an entity's text begins with (`Type: ...`), a word of under 50 letters; else Unknown."""
    second = F.trim(F.get(F.split(content, "\n", 3), 1))
    kind = F.trim(F.split(second, ":", 2)[0])
    return F.when(F.contains(second, F.lit(":")) & (kind != "") & (F.length(kind) < 50) & ~F.contains(kind, F.lit(" ")), kind).otherwise("Unknown")


def pair_of_key(key: Column, separator: str = "<SEP>") -> Column:
    """struct<src, tgt> of a relation's key; null if it hasn't two parts."""
    parts = F.split(key, re.escape(separator), -1)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("src"), parts[1].alias("tgt")))


def recovered_json(text: Column, schema: str) -> Column:
    """The value of JSON inside an answer: fenced, or from the first opening bracket to the last closing one; null if it can't be read."""
    inner = F.coalesce(F.when(text.rlike(r"(?s)```"), F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)), text)
    body = F.regexp_extract(inner, r"(?s)([\[{].*[\]}])", 1)
    return F.from_json(F.when(body != "", body), schema)


def safe_filename(name: Column) -> Column:
    """A file name without path separators, `..`, control characters, and blanks or dots at its ends; null if nothing is left."""
    x = F.regexp_replace(F.regexp_replace(name, r"[/\\]", ""), r"\.\.", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[\x00-\x1f\x7f]", ""), r"^[\s.]+|[\s.]+$", "")
    return F.when(x != "", x)


def workspace(name: Column) -> Column:
    """A workspace's name: `default` if empty, null if it holds anything but letters, digits and `_`."""
    x = F.trim(F.coalesce(name, F.lit("")))
    return F.when(x == "", "default").when(x.rlike("^[A-Za-z0-9_]+$"), x)


def identifier(name: Column) -> Column:
    """A name that can stand in SQL: a letter or `_`, then at most 62 letters, digits and `_`; else null."""
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]{0,62}$"), name)


def content_summary(text: Column, most: int = 250) -> Column:
    """The first characters of what a text says: without page marks, tags, image marks, signs of headings and lists and rules of tables; cut at a word."""
    x = F.regexp_replace(text, r"(?i)<!--\s*PAGE\s+\d+\s*-->", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"\[[Ii]mage\s+\d+:[^\]]*\]", " ")
    plain = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(s), r"^#{1,6}\s*", ""), r"^[-*+]\s+", ""), r"\s+", " "))
    lines = F.filter(F.transform(F.split(x, r"\r?\n"), plain), lambda s: ~s.rlike(r"^[|:\-]*$"))
    whole = F.when(F.size(lines) > 0, F.array_join(lines, " ")).otherwise(F.trim(F.regexp_replace(text, r"\s+", " ")))
    head = F.substring(whole, 1, most)
    words = F.regexp_replace(head, r" [^ ]*$", "")
    cut = F.when(F.contains(head, F.lit(" ")) & (F.length(words) >= int(most * 0.6)), words).otherwise(head)
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.regexp_replace(cut, r"[ ,;:]+$", ""), F.lit("...")))


# The forms of ids and paths.
_MOST_ID, _RELATIVE = 128, (".", "..")


def document_id(value: Column) -> Column:
    """A trimmed document id of ASCII letters, digits, underscores and hyphens, at most 128; else null."""
    x = F.trim(F.regexp_replace(value, r"^\s+|\s+$", ""))
    return F.when(x.rlike(r"^[a-zA-Z0-9_-]+\z") & (F.length(x) <= _MOST_ID), x)


def number(value: Column, least: float | None = None, most: float | None = None) -> Column:
    """Text as a number between two bounds, both included; else null."""
    x = F.trim(value).try_cast("double")
    good = x.isNotNull()
    # NaN is under no bound and over none
    good = good if least is None else good & ((x >= least) | F.isnan(x))
    return F.when(good if most is None else good & ((x <= most) | F.isnan(x)), x)


def _object_path(value: Column, folder: bool) -> Column:
    x = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", "")
    inner = F.regexp_replace(x, "/$", "") if folder else x
    parts = F.split(inner, "/", -1)
    good = ~x.rlike(r"[\x00-\x1F\x7F\\]") & ~x.startswith("/") & ~F.contains(x, F.lit("//")) & ~F.exists(parts, lambda p: (p == "") | p.isin(*_RELATIVE))
    return F.when(good, x)


def object_key(value: Column) -> Column:
    """A trimmed key of an object store: not empty, no control signs, backslashes, empty or relative parts, no slash at either end; else null."""
    return _object_path(value, False)


def object_prefix(value: Column) -> Column:
    """A trimmed prefix, which ends with a slash; an empty one stays empty; else as object_key."""
    x = _object_path(value, True)
    empty = F.coalesce(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit("")) == ""
    return F.when(empty, "").otherwise(F.when(x.endswith("/"), x).otherwise(F.concat(x, F.lit("/"))))
