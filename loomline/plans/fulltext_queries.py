"""Cover-density rank over documents, from an inverted table with places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fulltext
from .registry import query, table

_LOW = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _covers(words: list[str], source: str, weight: str = "0.1::DOUBLE") -> str:
    """SQL of the definition for words that all have to come: occ(id, w, pos), the last place of each word, stretches, covers."""
    last = ", ".join(f"max(pos) FILTER (w = '{w}') OVER u AS l{i}" for i, w in enumerate(words))
    have = " AND ".join(f"l{i} IS NOT NULL" for i in range(len(words)))
    least = f"least({', '.join(f'l{i}' for i in range(len(words)))})" if len(words) > 1 else "l0"
    return f"""occ AS ({source}), lasts AS (SELECT id, pos, 1 / ({weight}) AS inv, row_number() OVER u AS n, sum(1 / ({weight})) OVER u AS total, {last} FROM occ WINDOW u AS (PARTITION BY id ORDER BY pos)),
spans AS (SELECT *, {least} AS b, lag({least}) OVER (PARTITION BY id ORDER BY pos) AS was FROM lasts WHERE {have}),
covers AS (SELECT s.id, (s.n - f.n + 1) / (s.total - f.total + f.inv) / (1 + (s.pos - s.b) - (s.n - f.n)) AS part FROM spans s JOIN lasts f ON s.id = f.id AND s.b = f.pos WHERE s.was IS NULL OR s.b > s.was),
scores AS (SELECT id, sum(part) AS s FROM covers GROUP BY id)"""


_TOP = "SELECT id AS doc_id, row_number() OVER (ORDER BY round(s / (s + 1), 6) DESC, id)::INT AS rank, round(s / (s + 1), 6) AS score FROM scores ORDER BY rank LIMIT 20"
_PLACES = f"SELECT doc_id AS id, unnest({_LOW.format('text')}) AS w, unnest(range(len({_LOW.format('text')}))) AS pos FROM documents"


@query(f"WITH {_covers(['the', 'of', 'that'], f'SELECT * FROM ({_PLACES}) WHERE w IN (' + chr(39) + 'the' + chr(39) + ', ' + chr(39) + 'of' + chr(39) + ', ' + chr(39) + 'that' + chr(39) + ')')} {_TOP}")
def cover_density_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with three words, those first in which they often stand close."""
    places = fulltext.positions(table(spark, sf_dir, "documents"), "doc_id")
    return fulltext.ranked(places, fulltext.question("the of that"), 20, "doc_id")


@query(f"""WITH occ AS (SELECT * FROM ({_PLACES}) WHERE w IN ('die', 'und', 'with', 'of', 'the')),
marked AS (SELECT id, pos, w, row_number() OVER u AS n, max(pos) FILTER (w = 'die') OVER u AS d, max(pos) FILTER (w = 'und') OVER u AS e, lag(w) OVER u AS w1, lag(pos) OVER u AS a1 FROM occ WINDOW u AS (PARTITION BY id ORDER BY pos)),
phrases AS (SELECT *, max(a1) FILTER (a1 = pos - 1 AND w1 = 'of' AND w = 'the') OVER (PARTITION BY id ORDER BY pos) AS p FROM marked),
spans AS (SELECT *, greatest(least(coalesce(d, -1), coalesce(e, -1)), coalesce(p, -1)) AS b FROM phrases),
covers AS (SELECT s.id, 0.1::DOUBLE / (1 + (s.pos - s.b) - (s.n - f.n)) AS part FROM (SELECT *, lag(b) OVER (PARTITION BY id ORDER BY pos) AS was FROM spans) s JOIN spans f ON s.id = f.id AND s.b = f.pos WHERE s.b >= 0 AND (s.was IS NULL OR s.b > s.was)),
scores AS (SELECT id, sum(part) AS s FROM covers WHERE id NOT IN (SELECT id FROM occ WHERE w = 'with') GROUP BY id) {_TOP}""")
def cover_density_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words anywhere, or a phrase; texts with an excluded word left out."""
    places = fulltext.positions(table(spark, sf_dir, "documents"), "doc_id")
    return fulltext.ranked(places, fulltext.question('die und OR "of the" -with'), 20, "doc_id")


_HEADED = "SELECT doc_id, '# ' || source || ' ' || lang || chr(10) || coalesce(text, '') AS text FROM documents"
_PARTS = f"""SELECT id, w, pos, pos < h AS head FROM (SELECT doc_id AS id, len(hs) AS h, unnest(list_concat(hs, bs)) AS w, unnest(range(len(hs) + len(bs))) AS pos FROM
  (SELECT doc_id, {_LOW.format("array_to_string(regexp_extract_all(text, '(?m)^#+\\s+(.*)$', 1), ' ')")} AS hs, {_LOW.format("regexp_replace(text, '(?m)^#+\\s+.*$', '', 'g')")} AS bs FROM ({_HEADED}))) WHERE w IN ('en', 'the')"""


@query(f"WITH {_covers(['en', 'the'], _PARTS, 'CASE WHEN head THEN 1.0 ELSE 0.4 END::DOUBLE')} {_TOP}")
def cover_density_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of headings weigh more; every document is under a heading of its source and language."""
    head = F.concat(F.lit("# "), "source", F.lit(" "), "lang", F.lit("\n"), F.coalesce("text", F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", head.alias("text"))
    places = fulltext.positions(d, "doc_id", headings=True)
    return fulltext.ranked(places, fulltext.question("en the"), 20, "doc_id")


@query()
def cover_density_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words as stems of its own language; a German question by its stems."""
    places = fulltext.positions(table(spark, sf_dir, "documents"), "doc_id", language=F.col("lang"))
    return fulltext.ranked(places, fulltext.question("enlichen ungen", "german"), 20, "doc_id")


@query(f"SELECT w AS term, doc_id, list(pos ORDER BY pos) AS places FROM (SELECT id AS doc_id, w, pos::INT AS pos FROM ({_PLACES})) GROUP BY ALL")
def positional_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole inverted table with places."""
    places = fulltext.whole_positions(table(spark, sf_dir, "documents"), "doc_id")
    return places.select("term", "doc_id", F.transform("places", lambda p: p["at"]).alias("places"))
