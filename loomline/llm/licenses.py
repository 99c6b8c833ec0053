"""Licence scan: windows of texts against licence templates by the Dice coefficient of their word bigrams.

Text is lower-cased and cut into words of ASCII letters, digits and characters outside ASCII, so line
breaks, comment marks and brackets don't matter. With a and b distinct bigrams, two of which c are
shared, the coefficient is 2c / (a + b). As c is at most the smaller of both, the threshold t asks for
t / (2 - t) <= a / b <= (2 - t) / t, and for c >= t / (2 - t) * b: text that lacks every one of some
words of a template, whose bigrams are more than the rest allows, cannot reach it. Such needed words
(the longest first) give the places to compare: where one occurs, the window of the template's number
of words that lays it on the word's place in the template, cut at the text's ends. A window outside
the size bounds goes before its bigrams are compared. So a licence is found as a whole document, as a
notice wrapped over lines, or inside a longer line. Everything is one projection of DataFrame
functions: no shuffle, no Python.

Texts of licences are alike (LGPL-2.1 and GPL-2.0, BSD of two and of three clauses). Templates whose bigrams are
for half or more in another's are its rivals; a match whose window lies for half or more in that of a rival of another
licence, which shares more bigrams (or as many, at a better score), is that licence's text and goes.

Defined results: null and empty texts, and texts of one word, match nothing; of equal scores the
licence first by name is best; repeated rows give the same result each; an empty table gives no rows;
columns named like the results are replaced, all others stay.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .shared import free

THRESHOLD = 0.8
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return re.sub(_BETWEEN, " ", text.lower()).split()


def bigrams_of(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def needed_words(words: list[str], threshold: float) -> list[str]:
    """Words of a template of which a text must hold at least one to reach the threshold."""
    bigrams = bigrams_of(words)
    spare = len(bigrams) - threshold / (2 - threshold) * len(bigrams)
    lost: set[str] = set()
    out: list[str] = []
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(lost) > spare + 1e-9:
            break
        lost |= {b for b in bigrams if word in b.split()}
        out.append(word)
    return out


def anchors(templates: list[tuple[str, str]], threshold: float) -> list[tuple[str, int, int]]:
    """(needed word, template, its place there) of all templates that have bigrams."""
    out = []
    for t, (_, text) in enumerate(templates):
        words = words_of(text)
        need = set(needed_words(words, threshold)) if len(words) > 1 else set()
        out += [(w, t, at) for at, w in enumerate(words) if w in need]
    return out


def rivals(templates: list[tuple[str, str]]) -> list[list[int]]:
    """For each template, those of other licences that hold half of its bigrams or more."""
    sets = [(name, set(bigrams_of(words_of(text)))) for name, text in templates]
    return [[o for o, (other, b) in enumerate(sets) if other != name and a and 2 * len(a & b) >= len(a)] for name, a in sets]


def _known(value: object, kind: str) -> Column:
    """A constant of nested type, as one literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


MATCH = "array<struct<license:string,score:double,t:int,shared:int,begin:int,end:int,rivals:array<int>>>"


def matches(words: Column, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """MATCH of all windows of an array of words that reach the threshold."""
    places: dict[str, list] = {}
    for w, t, at in anchors(templates, threshold):
        places.setdefault(w, []).append({"t": t, "at": at})
    if not places:
        return F.array().cast(MATCH)
    by_word = _known(places, "map<string,array<struct<t:int,at:int>>>")
    catalogue = [
        {"license": name, "size": len(w := words_of(text)), "bigrams": bigrams_of(w), "rivals": others}
        for (name, text), others in zip(templates, rivals(templates), strict=True)
    ]
    known = _known(catalogue, "array<struct<license:string,size:int,bigrams:array<string>,rivals:array<int>>>")
    spots = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(*places), i)))
    tries = F.array_distinct(F.flatten(F.transform(spots, lambda i: F.transform(by_word[words[i]], lambda p: F.struct(p.t.alias("t"), (i - p.at).alias("begin"))))))
    low = threshold / (2 - threshold)

    def window(begin: Column, end: Column) -> Column:
        most = end - begin - 1
        return F.array_distinct(F.zip_with(F.slice(words, begin + 1, most), F.slice(words, begin + 2, most), lambda a, b: F.concat_ws(" ", a, b)))

    def score(x: Column, template: Column) -> Column:
        begin, end = F.greatest(x.begin, F.lit(0)), F.least(x.begin + template.size, F.size(words))

        def shared(own: Column) -> Column:
            a, b = F.size(own), F.size(template.bigrams)
            fits = (a >= low * b) & (a <= b / low)
            return F.struct(F.when(fits, F.size(F.array_intersect(own, template.bigrams))).alias("c"), (a + b).alias("n"))

        def match(s: Column) -> Column:
            dice = (2.0 * s.c / s.n).alias("score")
            return F.struct(template.license.alias("license"), dice, x.t.alias("t"), s.c.alias("shared"), begin.alias("begin"), end.alias("end"), template.rivals.alias("rivals"))

        # arrays of one element name what is used twice
        return F.transform(F.transform(F.array(window(begin, end)), shared), match)

    scored = F.flatten(F.transform(tries, lambda x: F.flatten(F.transform(F.array(known[x.t]), lambda t: score(x, t)))))
    return F.filter(scored, lambda s: s.score >= threshold)


def strongest(found: Column) -> Column:
    """MATCH without those that a rival's better match covers by half or more."""

    def better(m: Column, o: Column) -> Column:
        common = F.least(m.end, o.end) - F.greatest(m.begin, o.begin)
        more = (o.shared > m.shared) | ((o.shared == m.shared) & (o.score > m.score))
        return F.array_contains(m.rivals, o.t) & (2 * common >= m.end - m.begin) & more

    kept = F.filter(found, lambda m: (F.size(m.rivals) == 0) | ~F.exists(found, lambda o: better(m, o)))
    return F.when(F.size(F.array_distinct(F.transform(found, lambda m: m.license))) > 1, kept).otherwise(found)


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_licenses, licenses (by name, comma-joined), best_license and best_score (null without a match)."""
    kept = docs.drop("n_licenses", "licenses", "best_license", "best_score")
    words, new = free(docs, "_words"), free(docs, "_found")
    cut = docs.withColumn(words, F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN, " ")), " "))
    found = cut.withColumn(new, matches(F.col(words), templates, threshold)).withColumn(new, strongest(F.col(new)))
    best = F.element_at(F.array_sort(F.transform(new, lambda m: F.struct((-m.score).alias("less"), m.license.alias("license")))), 1)
    some = F.size(new) > 0
    names = F.array_sort(F.array_distinct(f"{new}.license"))
    return found.select(
        *kept.columns,
        F.size(names).cast("long").alias("n_licenses"),
        F.array_join(names, ",").alias("licenses"),
        F.when(some, best.license).alias("best_license"),
        F.when(some, F.round(-best.less, 6)).alias("best_score"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


_SQL_BIGRAMS = r"list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
_SQL_WORDS = rf"string_split(trim(regexp_replace(lower(coalesce(x, '')), '{_BETWEEN}', ' ', 'g'), ' '), ' ')"
_SQL_TEMPLATES = ", ".join("({}, '{}', '{}')".format(t, name, text.replace("'", "''")) for t, (name, text) in enumerate(TEMPLATES))
_SQL_RIVALS = ", ".join(f"({t}, {o})" for t, others in enumerate(rivals(TEMPLATES)) for o in others)
_SQL_ANCHORS = ", ".join(f"('{w}', {t}, {at})" for w, t, at in anchors(TEMPLATES, THRESHOLD))
OP6_SQL = rf"""
WITH t AS (SELECT t, license, len(w) AS size, {_SQL_BIGRAMS} AS b FROM (SELECT t, license, {_SQL_WORDS} AS w FROM (VALUES {_SQL_TEMPLATES}) v(t, license, x))),
a AS (SELECT * FROM (VALUES {_SQL_ANCHORS}) v(word, t, place)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM (SELECT doc_id, text AS x FROM documents)),
p AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
tries AS (SELECT DISTINCT r, t, i - place AS s FROM p JOIN a USING (word)),
v AS (SELECT * FROM (VALUES {_SQL_RIVALS}) v(t, other)),
win AS (SELECT tries.r, t.t, greatest(s, 0) AS lo, least(s + size, len(d.w)) AS hi, d.w[greatest(s, 0) + 1:least(s + size, len(d.w))] AS w FROM tries JOIN t USING (t) JOIN d ON tries.r = d.r),
own AS (SELECT r, t, lo, hi, {_SQL_BIGRAMS} AS o FROM win),
x AS (SELECT r, t, lo, hi, license, len(list_intersect(o, b)) AS c, len(o) + len(b) AS n FROM own JOIN t USING (t)),
y AS (SELECT *, 2.0::DOUBLE * c / n AS score FROM x WHERE 2.0::DOUBLE * c / n >= {THRESHOLD}),
lost AS (SELECT DISTINCT a.r, a.t, a.lo, a.hi FROM y a JOIN v ON v.t = a.t JOIN y o ON o.r = a.r AND o.t = v.other AND 2 * (least(a.hi, o.hi) - greatest(a.lo, o.lo)) >= a.hi - a.lo AND (o.c > a.c OR (o.c = a.c AND o.score > a.score))),
m AS (SELECT y.* FROM y ANTI JOIN lost ON lost.r = y.r AND lost.t = y.t AND lost.lo = y.lo AND lost.hi = y.hi),
best AS (SELECT r, count(DISTINCT license) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS ids, first(license ORDER BY score DESC, license) AS license, max(score) AS score
  FROM m WHERE score >= {THRESHOLD} GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(ids, '') AS licenses, license AS best_license, round(score, 6) AS best_score
FROM d LEFT JOIN best USING (r)
"""
