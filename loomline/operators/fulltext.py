"""Full text by positions: an inverted table with places, boolean questions with phrases, and cover-density rank.

Rank is that of cover density: a cover is a stretch of a text in which the question holds and of which no
part does. Each adds the harmonic mean weight of the asked words in it, divided by one more than the words in it
that weren't asked; so words that stand close, in more places, rank higher. Body words weigh 0.1 (0.4 where
headings are told apart, which weigh 1.0), and the sum s becomes s / (s + 1).

Defined results: null and empty texts hold no words; ties of score go to the smaller id.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stems
from ..functions import texts as T

#: A word: letters and digits of any script.
WORD = r"[\p{L}\p{N}]+"
_PY_WORD = re.compile(r"[^\W_]+")

# Weights of words by where they stand.
PLAIN, BODY, HEADING = 0.1, 0.4, 1.0
_HEAD = r"(?m)^#+\s+(.*)$"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def positions(rows: DataFrame, id_: str, text: str = "text", language: str | Column | None = None, headings: bool = False, stopwords: Sequence[str] = ()) -> DataFrame:
    """(term, id, places): for each text and word its places (at, weight) in order, counted from 0.

    With a language (or a column of them) words are stems; stop words are left out and still take a place. With headings, the words of
    Markdown headings come first, with more weight."""
    t = F.col(text)
    body, head = (F.regexp_replace(t, _HEAD, ""), F.array_join(F.regexp_extract_all(t, F.lit(_HEAD), 1), " ")) if headings else (t, F.lit(None).cast("string"))
    name = language if isinstance(language, Column) else F.lit(language).cast("string")
    cut = rows.select(F.col(id_), name.alias("_l"), F.coalesce(_words(head), F.array().cast("array<string>")).alias("_h"), _words(body).alias("_b")).where("_b IS NOT NULL")
    cut = cut.select(id_, "_l", F.size("_h").alias("_n"), F.concat("_h", "_b").alias("_w"))
    if language is not None:
        cut = cut.withColumn("_s", stems.stemmed(F.col("_w"), F.coalesce("_l", F.lit("simple"))))
    else:
        cut = cut.withColumn("_s", F.col("_w"))
    each = cut.select(id_, "_n", F.posexplode(F.arrays_zip("_w", "_s")).alias("at", "_x")).select(id_, "_n", "at", "_x.*")
    if stopwords:
        each = each.where(~F.col("_w").isin(list(stopwords)))
    weight = F.when(F.col("at") < F.col("_n"), HEADING).otherwise(BODY) if headings else F.lit(PLAIN)
    placed = each.select(F.col("_s").alias("term"), id_, F.struct("at", weight.alias("weight")).alias("_p"))
    return placed.groupBy("term", id_).agg(F.sort_array(F.collect_list("_p")).alias("places"))


def whole_positions(rows: DataFrame, id_: str, text: str = "text") -> DataFrame:
    """The rows of positions of plain words, for a table that is kept or read as a whole: texts are shuffled, by id, and words are grouped within them.

    Where few words are asked, positions is the better way: it drops the others before it groups."""
    placed = lambda t: F.transform(_words(t), lambda w, i: F.struct(w.alias("term"), i.alias("at")))
    texts = rows.groupBy(id_).agg(F.collect_list(text).alias("_t")).select(id_, F.flatten(F.transform("_t", placed)).alias("_p"))
    found = T.runs(F.sort_array("_p"), lambda x: x["term"], lambda part: F.transform(part, lambda x: F.struct(x["at"].alias("at"), F.lit(PLAIN).alias("weight"))), "places")
    return texts.select(id_, F.inline(found)).select("term", id_, "places")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_positions(table: DataFrame, path: str, id_: str, buckets: int = 256, files: int = 1) -> None:
    """Write an inverted table in buckets of terms, each sorted by term and dealt to so many files: frequent terms then lie in several."""
    salted = table.withColumn("bucket", bucket_of(F.col("term"), buckets))
    salted.repartition("bucket", F.pmod(F.xxhash64(id_), F.lit(files))).sortWithinPartitions("bucket", "term", id_).write.partitionBy("bucket").mode("overwrite").parquet(path)


def read_positions(spark: SparkSession, path: str, question: Question, buckets: int = 256) -> DataFrame:
    """The rows of the question's terms: only their buckets' files are opened, and of those only the parts that hold the terms."""
    terms = question.terms()
    numbers = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"), buckets)).distinct().collect()] if terms else []
    return spark.read.parquet(path).where(F.col("bucket").isin(numbers) & F.col("term").isin(terms)).drop("bucket")


@dataclass(frozen=True)
class Question:
    """Groups of words, one of which has to hold: (words, whether they stand in a row); and words that must not come."""

    groups: tuple[tuple[tuple[str, ...], bool], ...]
    excluded: tuple[str, ...] = ()

    def asked(self) -> list[str]:
        return list(dict.fromkeys(w for words, _ in self.groups for w in words))

    def terms(self) -> list[str]:
        return sorted({*self.asked(), *self.excluded})


def question(text: str, language: str | None = None, phrases: Sequence[str] = (), stopwords: Sequence[str] = ()) -> Question:
    """All words of a text; or, where it holds quotes, OR, or words with a minus before, what these say: quoted words stand in a row, OR parts choices.

    Phrases of two words and more are further choices, as are their words in a row. A quoted part beside other words counts by its words and its own group by their order."""
    stem = stems.STEMMERS[language] if language else stems.STEMMERS["simple"]
    cut = lambda x: tuple(stem(w) for w in _PY_WORD.findall(x.lower()) if w not in stopwords)
    advanced = '"' in text or re.search(r"\bOR\b", text) or re.search(r"(?:^|\s)-\w", text)
    groups: list[tuple[tuple[str, ...], bool]] = []
    excluded: list[str] = []
    for choice in re.split(r"\bOR\b", text) if advanced else [text]:
        words: list[str] = []
        quoted: list[tuple[str, ...]] = []
        for minus, quote, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', choice) if advanced else [("", "", choice)]:
            found = cut(quote or word)
            if minus:
                excluded += found
            elif quote and len(found) > 1:
                quoted.append(found)
            else:
                words += found
        if len(quoted) == 1 and not words:
            groups.append((quoted[0], True))
        else:
            words += [w for q in quoted for w in q]
            if words:
                groups.append((tuple(dict.fromkeys(words)), False))
    groups += [(p, True) for p in map(cut, phrases) if len(p) > 1]
    return Question(tuple(dict.fromkeys(groups)), tuple(dict.fromkeys(excluded)))


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p["at"] + by)


def _entries(places: Column, slot: int) -> Column:
    """Places of a word for the merge: of is what it adds to the sum of inverse weights."""
    return F.transform(places, lambda p: F.struct(p["at"].alias("at"), F.lit(1).alias("kind"), F.lit(slot).alias("slot"), (1 / p["weight"]).alias("of")))


def _marks(ends: Column, slot: int, words: int) -> Column:
    """Ends of a phrase for the merge, before the words that stand there: of is how many words it has."""
    return F.transform(ends, lambda e: F.struct(e.alias("at"), F.lit(0).alias("kind"), F.lit(slot).alias("slot"), F.lit(float(words)).alias("of")))


def _phrase_ends(words: Sequence[str], places: dict[str, Column]) -> Column:
    """Places at which words that stand in a row end."""
    last = len(words) - 1
    shifted = [_shifted(places[w], last - k) for k, w in enumerate(words)]
    ends = shifted[0]
    for s in shifted[1:]:
        ends = F.array_intersect(ends, s)
    return ends


def cover_density(asked: Question, places: dict[str, Column]) -> Column:
    """The sum over all covers, from a column of sorted places for each asked word (null: none); null where the question nowhere holds.

    Places of all words are merged in order and passed once: the state has the last place of each word and phrase, from which the
    shortest stretch that ends here follows; it is a cover if it begins behind the one before."""
    words = asked.asked()
    empty = F.array().cast("array<struct<at:int,weight:double>>")
    places = {w: F.coalesce(places[w], empty) for w in words}
    rows = [(k, g) for k, (g, in_row) in enumerate(asked.groups) if in_row and len(g) > 1]
    slots = {**{w: i for i, w in enumerate(words)}, **{k: len(words) + i for i, (k, _) in enumerate(rows)}}
    longest = max([1, *(len(g) for _, g in rows)])
    marks = [_marks(_phrase_ends(g, places), slots[k], len(g)) for k, g in rows]
    each = [_entries(places[w], slots[w]) for w in words]
    merged = F.array_sort(F.concat(*marks, *each))

    def place(at: Column, n: Column, sum_: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), n.cast("int").alias("n"), sum_.cast("double").alias("sum"))

    nowhere = place(F.lit(-1), F.lit(0), F.lit(0.0))

    def state(last: Column, n: Column, total: Column, before: Column, begun: Column, score: Column) -> Column:
        return F.struct(last.alias("last"), n.cast("int").alias("n"), total.alias("total"), before.alias("before"), begun.cast("int").alias("begun"), score.alias("score"))

    start = state(F.array_repeat(nowhere, len(slots)), F.lit(0), F.lit(0.0), F.array_repeat(F.lit(0.0), longest), F.lit(-1), F.lit(0.0))

    def put(last: Column, slot: Column, new: Column) -> Column:
        return F.transform(last, lambda x, i: F.when(i == slot, new).otherwise(x))

    def step(s: Column, x: Column) -> Column:
        back = x["of"].cast("int") - 1
        # the word that ends a phrase isn't counted yet: it began `back` words before
        mark = put(s["last"], x["slot"], place(x["at"] - back, s["n"] - back, F.when(back == 0, s["total"]).otherwise(F.element_at(s["before"], F.when(back == 0, -1).otherwise(-back)))))
        word = put(s["last"], x["slot"], place(x["at"], s["n"], s["total"]))
        held = state(F.when(x["kind"] == 0, mark).otherwise(word), F.when(x["kind"] == 0, s["n"]).otherwise(s["n"] + 1), F.when(x["kind"] == 0, s["total"]).otherwise(s["total"] + x["of"]),
                     F.when(x["kind"] == 0, s["before"]).otherwise(F.slice(F.concat(s["before"], F.array(s["total"])), -longest, longest)), s["begun"], s["score"])
        return F.element_at(F.transform(F.array(held), lambda h: F.when(x["kind"] == 0, h).otherwise(covered(h, x))), 1)

    def covered(h: Column, x: Column) -> Column:
        ends = [h["last"][slots[k]] if k in slots else F.least(*[h["last"][slots[w]] for w in g]) if len(g) > 1 else h["last"][slots[g[0]]] for k, (g, _) in enumerate(asked.groups)]
        begin = F.greatest(*ends) if len(ends) > 1 else ends[0]
        n = h["n"] - begin["n"]
        more = n / (h["total"] - begin["sum"]) / (1 + (x["at"] - begin["at"]) - (n - 1))
        new = begin["at"] > h["begun"]
        return state(h["last"], h["n"], h["total"], h["before"], F.when(new, begin["at"]).otherwise(h["begun"]), F.when(new, h["score"] + more).otherwise(h["score"]))

    done = F.aggregate(merged, start, step)
    return F.when(done["begun"] >= 0, done["score"])


def ranked(postings: DataFrame, asked: Question, k: int, id_: str) -> DataFrame:
    """(id, rank, score) of the k best texts for which a question holds, from an inverted table; only rows of its terms are read."""
    if not asked.groups:
        return postings.select(id_, F.lit(0).alias("rank"), F.lit(0.0).alias("score")).where("false")
    words, kept = asked.asked(), asked.terms()
    hits = postings.where(F.col("term").isin(kept))
    names = {w: f"_p{i}" for i, w in enumerate(words)}
    columns = [F.first(F.when(F.col("term") == w, F.col("places")), ignorenulls=True).alias(c) for w, c in names.items()]
    if asked.excluded:
        columns.append(F.bool_or(F.col("term").isin(list(asked.excluded))).alias("_x"))
    each = hits.groupBy(id_).agg(*columns)
    if asked.excluded:
        each = each.where("NOT _x")
    whole = [" AND ".join(f"{names[w]} IS NOT NULL" for w in g) for g, _ in asked.groups]
    each = each.where(" OR ".join(f"({c})" for c in whole))
    score = cover_density(asked, {w: F.col(c) for w, c in names.items()})
    best = each.select(id_, score.alias("_s")).where("_s IS NOT NULL").select(id_, F.round(F.col("_s") / (F.col("_s") + 1), 6).alias("score"))
    best = best.orderBy(F.desc("score"), id_).limit(k)
    return best.select(id_, F.row_number().over(Window.orderBy(F.desc("score"), id_)).alias("rank"), "score")
