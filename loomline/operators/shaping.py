"""Shaping of ranked chunks: lexical scores, caps, budgets, references, reordering."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts as T
from .lineage import cut


def lexical_score(text: Column, terms: Sequence[str]) -> Column:
    """How well a text holds weighted terms, 0 to 1.

    A word counts 0.7, and 0.15 more for each repeat up to two; a phrase 0.8, and 0.1 more a repeat, or 0.6 if the text has all its words apart."""
    if not terms:
        return F.lit(0.0)
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))

    def strength(plain: Column, words: Column, term: str) -> Column:
        if " " not in term:
            n = F.size(F.filter(words, lambda w: w == F.lit(term)))
            return F.when(n > 0, F.least(F.lit(1.0), 0.7 + 0.15 * F.least(n - 1, F.lit(2)))).otherwise(0.0)
        n = F.size(F.split(plain, F.lit(re.escape(term)), -1)) - 1
        apart = reduce(lambda x, y: x & y, [F.array_contains(words, t) for t in re.findall(T.TOKEN, term)])
        return F.when(n > 0, F.least(F.lit(1.0), 0.8 + 0.1 * (n - 1))).when(apart, 0.6).otherwise(0.0)

    terms = list(dict.fromkeys(terms))
    total = sum((T.term_weight(F.lit(t)) for t in terms[1:]), T.term_weight(F.lit(terms[0])))
    # the words are named, so that a text is cut into them once
    named = F.array(F.struct(plain.alias("plain"), T.tokens(text).alias("words")))
    hit = F.transform(named, lambda x: sum((T.term_weight(F.lit(t)) * strength(x.plain, x.words, t) for t in terms), F.lit(0.0)))
    return F.round(F.least(F.element_at(hit, 1) / total, F.lit(1.0)), 6)


#: Scores that a chunk may come with, the first that it has counts.
SCORES = ("rerank_score", "merge_score", "retrieval_score", "rrf_score", "score", "similarity", "cosine_similarity")


def base_score(columns: Sequence[str]) -> Column:
    """The first score that is there, else 1 / (1 + distance), else null; columns: those the rows have."""
    found = [F.col(c).cast("double") for c in SCORES if c in columns]
    if "distance" in columns:
        found.append(F.when(F.col("distance").isNotNull(), 1 / (1 + F.greatest(F.col("distance").cast("double"), F.lit(0.0)))))
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def generic_path(path: Column) -> Column:
    """Whether a path names no document: empty, unknown, or a placeholder's name."""
    name = F.lower(F.element_at(F.split(F.regexp_replace(F.trim(path), "/+$", ""), "/"), -1))
    return F.coalesce(F.trim(path) == "", F.lit(True)) | (F.trim(path) == "unknown_source") | name.rlike(r"^(?:processed|test_doc[0-9]*)(?:\.[a-z0-9]+)?$")


def document_key(s3_key: Column, path: Column, title: Column, chunk_id: Column) -> Column:
    """What groups chunks into documents: the key of the store, a path that names a document, the title, or the chunk itself; empty if there is none of them."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(some(s3_key), F.when(~generic_path(path), F.trim(path)), some(title), some(chunk_id), F.when(F.trim(path) != "unknown_source", F.trim(path)), F.lit(""))


def above_floor(rows: DataFrame, score: str, least: float) -> DataFrame:
    """rows that reach a score; those without one stay."""
    return rows.where(F.coalesce(score, F.lit(100.0)) >= least)


def chunk_limit(n_tokens: int, configured: int) -> int:
    """How many chunks a question without a known kind gets: half for up to three words, else all."""
    return min(configured, max(2, configured // 2)) if n_tokens <= 3 else configured


def normalized(rows: DataFrame, score: str, rank: str, by: Sequence[str]) -> DataFrame:
    """rows with base: min-max of the score inside each list; without any score by position; where all are equal 1, without a score 0."""
    every = Window.partitionBy(*by)
    low, high, n = F.min(score).over(every), F.max(score).over(every), F.count("*").over(every)
    by_place = F.when(n > 1, 1 - (F.col(rank) - 1) / (n - 1)).otherwise(1.0)
    spread = F.when(F.col(score).isNull(), 0.0).when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low))
    return rows.withColumn("base", F.when(high.isNull(), by_place).otherwise(spread))


def lexical_boost(rows: DataFrame, terms: Sequence[str], text: str, rank: str, by: Sequence[str], weight: float = 0.2, score: str = "score") -> DataFrame:
    """Each list reordered by (1 - weight) * base + weight * lexical, then lexical, then its rank; unchanged where no row has a term."""
    out = normalized(rows, score, rank, by).withColumn("lexical", lexical_score(F.col(text), terms))
    some = F.max("lexical").over(Window.partitionBy(*by)) > 0
    out = out.withColumn("final", F.round((1 - weight) * F.col("base") + weight * F.col("lexical"), 6)).withColumn("_some", some)
    order = Window.partitionBy(*by).orderBy(F.when(F.col("_some"), -F.col("final")).otherwise(0.0), F.when(F.col("_some"), -F.col("lexical")).otherwise(0.0), rank)
    return out.withColumn("new_rank", F.row_number().over(order)).drop("_some")


#: Signals of support, the strongest first.
SUPPORT = ("duration_answer_match", "impact_answer_match", "exact_phrase_match", "precise_focus_overlap", "priority_match", "metadata_query_match")


def support_order(rows: DataFrame, by: Sequence[str], rank: str, document: str) -> DataFrame:
    """Each list reordered by its chunks' signals of support (SUPPORT, nulls as 0), with support_rank.

    focused: whether the chunk's document has a chunk whose focus overlaps in full; where a list has such a document this goes before
    the phrase, else behind all signals. merge_score counts only for chunks with a signal; ties keep the rank."""
    value = {c: F.coalesce(F.col(c), F.lit(0.0)) if c in rows.columns else F.lit(0.0) for c in (*SUPPORT, "merge_score")}
    full = (value["precise_focus_overlap"] >= 1) & (F.col(document) != "")
    out = rows.withColumn("focused", F.max(full.cast("int")).over(Window.partitionBy(*by, document)).cast("double")).withColumn("_any", F.max(full.cast("int")).over(Window.partitionBy(*by)) > 0)
    first, rest = [value[c] for c in SUPPORT[:2]], [value[c] for c in SUPPORT[2:]]
    signal = F.greatest(*first, *rest, F.col("focused"))
    keys = [*first, F.when(F.col("_any"), F.col("focused")).otherwise(0.0), *rest, F.when(signal > 0, value["merge_score"]).otherwise(0.0)]
    return out.withColumn("support_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(k) for k in keys], rank))).drop("_any")


def cap_per_document(rows: DataFrame, doc: str, rank: str, most: int | Column, total: int | Column, by: Sequence[str], protected: Column | None = None, expand: bool | Column = False) -> DataFrame:
    """Of each list at most so many rows of a document in rank order, and in all.

    protected: a larger limit of the row's document; expand: a list of one document may have up to three (or `most`) of it."""
    total, most = (F.lit(x) if isinstance(x, int) else x for x in (total, most))
    documents = F.size(F.collect_set(doc).over(Window.partitionBy(*by)))
    limit = F.when(F.lit(expand) & (documents <= 1), F.least(total, F.greatest(most, F.lit(3)))).otherwise(most)
    limit = limit if protected is None else F.greatest(limit, protected)
    out = rows.withColumn("_l", limit).withColumn("_r", F.row_number().over(Window.partitionBy(*by, doc).orderBy(rank))).where(F.col("_r") <= F.col("_l"))
    return out.withColumn("_t", F.row_number().over(Window.partitionBy(*by).orderBy(rank))).where(F.col("_t") <= total).drop("_l", "_r", "_t")


def within_budget(rows: DataFrame, tokens: str, order: Sequence[Column], budget: int, by: Sequence[str]) -> DataFrame:
    """The rows of each list before the running sum of tokens passes the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(tokens).over(w)).where(F.col("running") <= budget)


def json_tokens(columns: Sequence[str]) -> Column:
    """Tokens of a chunk as it goes into a prompt: those of its JSON."""
    return F.size(T.tokens(F.to_json(F.struct(*columns))))


def stage_ranks(stages: Sequence[tuple[str, DataFrame]], by: Sequence[str], id_: str) -> DataFrame:
    """(by, id, a column a stage): the rank that each row had at each stage (null where it was gone); a stage's rows have `rank`."""
    every = reduce(DataFrame.unionByName, [part.select(*by, id_, F.lit(name).alias("_s"), "rank") for name, part in stages])
    return every.groupBy(*by, id_).pivot("_s", [name for name, _ in stages]).agg(F.min("rank"))


def numbered(rows: DataFrame, by: Sequence[str], order: str, prefix: str = "DC", name: str = "id") -> DataFrame:
    """rows with ids DC1, DC2, ... in the order of each list."""
    return rows.withColumn(name, F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(*by).orderBy(order))))


def _quotas(sizes: DataFrame, by: Sequence[str], group_rank: str, most: int, least: int) -> DataFrame:
    """sizes with quota: a share that falls linearly with the group's rank, rounded half to even."""
    n = F.max(group_rank).over(Window.partitionBy(*by))
    return sizes.withColumn("quota", F.when(n > 1, F.bround(most - (F.col(group_rank) - 1) / (n - 1) * (most - least))).otherwise(most).cast("int"))


def polled(rows: DataFrame, group_rank: str, item_rank: str, most: int, least: int, by: Sequence[str], rounds: int = 2) -> DataFrame:
    """Weighted polling of groups: first each group's quota, then (of two rounds) what groups with too few items leave goes to the earliest with items to spare.

    Windows are over the groups of a list, not over its items."""
    sizes = _quotas(rows.groupBy(*by, group_rank).agg(F.count("*").alias("size")), by, group_rank, most, least)
    spare = F.greatest(F.col("size") - F.col("quota"), F.lit(0))
    unused = F.sum(F.greatest(F.col("quota") - F.col("size"), F.lit(0))).over(Window.partitionBy(*by))
    before = F.coalesce(F.sum(spare).over(Window.partitionBy(*by).orderBy(group_rank).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.least(spare, unused - before), F.lit(0)) if rounds > 1 else F.lit(0)
    sizes = sizes.withColumn("take", (F.least("quota", "size") + extra).cast("int"))
    return rows.join(sizes.select(*by, group_rank, "quota", "take"), [*by, group_rank]).where(F.col(item_rank) <= F.col("take"))


def interleaved(rows: DataFrame, id_: str, keyword: str, place: str, score: str, most: int, by: Sequence[str]) -> DataFrame:
    """(by, id, rank): candidates of several keywords in turn, each once, then the others by score.

    place: a candidate's place in its keyword's list; the turns take the first half of `most`."""
    turn = Window.partitionBy(*by).orderBy(place, keyword)
    first = Window.partitionBy(*by, id_).orderBy(place, keyword)
    once = rows.withColumn("_f", F.row_number().over(first)).where("_f = 1").withColumn("_t", F.row_number().over(turn))
    by_score = F.when(F.col("_t") <= most // 2, F.lit(None).cast("double")).otherwise(F.col(score))
    order = Window.partitionBy(*by).orderBy(F.when(F.col("_t") <= most // 2, F.col("_t")).otherwise(most), F.desc(by_score), id_)
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(*by, id_, "rank")


def references(rows: DataFrame, path: str, rank: str, text: str, by: Sequence[str], most: int = 10) -> DataFrame:
    """(by, reference_id, path, n, excerpt): files of each list by how many rows they have, then by their first row."""
    counted = rows.groupBy(*by, path).agg(F.count("*").alias("n"), F.min(rank).alias("_first"), F.min_by(T.excerpt(F.col(text)), rank).alias("excerpt"))
    out = counted.withColumn("reference_id", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "_first")))
    return out.where(F.col("reference_id") <= most).select(*by, "reference_id", path, "n", "excerpt")


#: Words that the local reranker leaves out.
RERANK_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "how", "in", "is", "of", "on", "or", "that", "the", "to", "was", "what", "when", "where", "which", "who", "with",
)


def local_rerank(rows: DataFrame, query: str, text: str, id_: str, k: int, phrases: Sequence[str] = ()) -> DataFrame:
    """(id, score, rank): recall + 0.35 precision + 0.25 a phrase + 0.15 a term with a digit that the query and the text share; 0 where either has no term.

    Terms are tokens of three characters or more that aren't stop words."""
    terms = lambda c: F.array_distinct(F.filter(T.tokens(c), lambda t: (F.length(t) > 2) & ~t.isin(*RERANK_STOPWORDS)))
    named = rows.select(id_, F.lower(text).alias("_low"), terms(F.col(text)).alias("_words"))
    want = sorted({t for t in re.findall(T.TOKEN, query.lower()) if len(t) > 2 and t not in RERANK_STOPWORDS})
    out = named.withColumn("_both", F.array_intersect(F.lit(want) if want else F.array().cast("array<string>"), "_words"))
    score = F.size("_both") / max(len(want), 1) + 0.35 * F.size("_both") / F.size("_words")
    for p in phrases:
        score = score + 0.25 * F.contains("_low", F.lit(p.lower())).cast("double")
    score = score + 0.15 * F.size(F.filter("_both", lambda t: t.rlike("[0-9]")))
    out = out.select(id_, F.when((F.size("_words") > 0) & F.lit(bool(want)), F.round(score, 6)).otherwise(0.0).alias("score")).orderBy(F.desc("score"), id_).limit(k)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_)))


def chunk_scores(rows: DataFrame, doc: str, score: str, position: Column, method: str = "max") -> DataFrame:
    """(doc, score) from the scores of its pieces: max, mean or first."""
    how = {"max": F.max(score), "mean": F.round(F.avg(score), 6), "first": F.min_by(score, position)}[method]
    return rows.groupBy(doc).agg(how.alias("score"))


def mmr(rows: DataFrame, query: str, id_: str, text: str, relevance: str, weight: float = 0.7, k: int = 10) -> DataFrame:
    """(query, id, rank): greedy maximal marginal relevance inside each query's candidates.

    The first is the most relevant; then weight * relevance - (1 - weight) * the largest Jaccard overlap with those taken,
    ties to the more relevant, then to the earlier. Texts without words come last. A query's candidates fit in a task: they are a ranked list."""
    words = F.array_distinct(T.tokens(F.col(text)))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([relevance, id_], ascending=[False, True], kind="stable")
        sets = [frozenset(w) for w in pdf["_words"]]
        relevant = pdf[relevance].to_numpy()
        left = [i for i, s in enumerate(sets) if s]
        taken: list[int] = []
        worst = np.zeros(len(sets))
        while left and len(taken) < k:
            best = max(left, key=lambda i: (weight * relevant[i] - (1 - weight) * worst[i] if taken else relevant[i], relevant[i], -i))
            taken.append(best)
            left.remove(best)
            for i in left:
                worst[i] = max(worst[i], len(sets[i] & sets[best]) / len(sets[i] | sets[best]))
        taken += [i for i, s in enumerate(sets) if not s][: k - len(taken)]
        return pd.DataFrame({query: pdf[query].iloc[0], id_: pdf[id_].to_numpy()[taken], "rank": np.arange(1, len(taken) + 1, dtype=np.int32)})

    kinds = dict(rows.dtypes)
    candidates = rows.select(query, id_, relevance, words.alias("_words"))
    return candidates.groupBy(query).applyInPandas(pick, f"{query} {kinds[query]}, {id_} {kinds[id_]}, rank int")


def merge_sources(parts: Sequence[tuple[str, DataFrame]], id_: str, score: str, weights: dict[str, float]) -> DataFrame:
    """(id, sources, score, occurrences): chunks of several searches as one list; sources joined as a+b in the given order.

    The weights are the library's own: convex, and larger for the vector leg."""
    every = None
    for n, (name, part) in enumerate(parts):
        part = part.select(F.col(id_), F.lit(n).alias("_n"), F.lit(name).alias("_s"), (F.col(score) * weights[name]).alias("_w"))
        every = part if every is None else every.unionByName(part)
    one = every.groupBy(id_, "_n", "_s").agg(F.max("_w").alias("_w"), F.count("*").alias("_c"))
    out = one.groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("_n", "_s"))).alias("_l"), F.round(F.sum("_w"), 6).alias("score"), F.sum("_c").alias("occurrences"))
    return out.select(id_, F.array_join("_l._s", "+").alias("sources"), "score", "occurrences")


def siblings(hits: DataFrame, chunks: DataFrame, doc: str, position: str, window: int) -> DataFrame:
    """chunks within so many places of a hit in the same document; an equi-join on the places around each hit."""
    around = hits.select(doc, F.explode(F.sequence(F.col(position) - window, F.col(position) + window)).alias(position)).distinct()
    return chunks.join(around, [doc, position], "left_semi")


#: Weights of a merged chunk's features, convex: retrieval before headings before body before facets and time; how many sources before how often before how early.
FEATURES = {"retrieval": 0.34, "heading": 0.20, "body": 0.14, "facet": 0.08, "temporal": 0.08, "source_count": 0.07, "occurrence": 0.05, "order": 0.04}


def merge_score(features: Mapping[str, Column]) -> Column:
    """The weighted sum of features between 0 and 1, those that are missing or null as 0."""
    total = F.lit(0.0)
    for name, weight in FEATURES.items():
        if name in features:
            total = total + weight * F.least(F.greatest(F.coalesce(features[name].cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.round(total, 6)


def merge_ranked(lists: Sequence[DataFrame], id_: str, by: Sequence[str], degrees: DataFrame, k: int) -> DataFrame:
    """(by, id, score, degree_share, rank): entities or relations of several scored lists, the best score of each, then the degree as a share of the largest of its list."""
    every = reduce(DataFrame.unionByName, [x.select(*by, id_, "score") for x in lists])
    best = every.groupBy(*by, id_).agg(F.max("score").alias("score")).join(degrees, id_, "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    most = F.max("degree").over(Window.partitionBy(*by))
    best = best.withColumn("degree_share", F.when(most > 0, F.round(F.col("degree") / most, 6)).otherwise(0.0))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("degree_share"), id_)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*by, id_, "score", "degree_share", "rank")


def matching(rows: DataFrame, fields: Sequence[str], name: str) -> DataFrame:
    """rows of which a field (text or array of texts) holds the name, whatever the case and signs."""
    plain = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    wanted = f" {re.sub(r'[^0-9a-z]+', ' ', name.lower()).strip()} " if name.isascii() else f" {' '.join(re.findall(r'[^\W_]+', name.lower()))} "
    kinds = dict(rows.dtypes)
    found = F.lit(False)
    for f in fields:
        text = F.concat_ws(" | ", f) if kinds[f].startswith("array") else F.coalesce(f, F.lit(""))
        found = found | F.contains(plain(text), F.lit(wanted))
    return rows.where(found)


def confident(rows: DataFrame, score: str, source: str, least: float, exempt: Sequence[str] = ("graph",)) -> DataFrame:
    """rows that reach a score, and those of sources that have none of their own."""
    return rows.where((F.coalesce(score, F.lit(0.0)) >= least) | F.col(source).isin(*exempt))


def supporting(references: DataFrame, answer: str, content: str, least: float = 0.5) -> DataFrame:
    """References (with answer and content, an array of texts) with only the contents that share at least so many of the answer's words of four letters or more.

    References without content stay; so do all contents of a list of one answer where none or every one would go."""
    words = lambda c: F.array_distinct(F.filter(T.tokens(c, T.WORD), lambda w: F.length(w) >= 4))
    named = references.withColumn("_a", words(F.col(answer)))
    kept = F.filter(content, lambda c: F.size(F.array_intersect(words(c), F.col("_a"))) >= least * F.greatest(F.size(words(c)), F.lit(1)))
    named = named.withColumn("_k", kept)
    by = Window.partitionBy(answer)
    n, m = F.sum(F.size(F.coalesce("_k", F.array().cast("array<string>")))).over(by), F.sum(F.size(F.coalesce(content, F.array().cast("array<string>")))).over(by)
    named = named.withColumn("_whole", (n == 0) | (n == m))
    keep = F.col(content).isNull() | F.col("_whole") | (F.size("_k") > 0)
    return named.where(keep).withColumn(content, F.when(F.col("_whole"), F.col(content)).otherwise(F.col("_k"))).drop("_a", "_k", "_whole")


def gated(rows: DataFrame, by: Sequence[str], entities: str, relations: str, covered: str, density: float = 0.3, coverage: float = 0.5) -> DataFrame:
    """(by, density, coverage, passes) of counts of entities, of relations among them, and of entities that the answer covers."""
    n = F.sum(entities)
    out = rows.groupBy(*by).agg(F.round(F.sum(relations) / F.when(n > 0, n), 6).alias("density"), F.round(F.sum(covered) / F.when(n > 0, n), 6).alias("coverage"))
    return out.withColumn("passes", (F.coalesce("density", F.lit(0.0)) >= density) & (F.coalesce("coverage", F.lit(0.0)) >= coverage))


def graph_references(entities: DataFrame, relations: DataFrame, chunks: DataFrame, by: Sequence[str], told: Callable[[Column], Column] | None = None) -> DataFrame:
    """(by, reference_id, file_path, kinds, n, contents): the files of entities and relations as references, the most used first, with the contents of their chunks.

    entities and relations: (by, file_path); chunks: (file_path, position, content). told: what is made of a file's contents, once a file and
    not once a reference, each of which carries what it gives."""
    items = entities.select(*by, "file_path", F.lit(True).alias("_e")).unionByName(relations.select(*by, "file_path", F.lit(False).alias("_e")))
    kinds = F.concat_ws("+", F.when(F.max("_e"), "entity"), F.when(~F.min("_e"), "relation"))
    files = items.where("file_path <> '' AND file_path <> 'unknown_source'").groupBy(*by, "file_path").agg(F.count("*").alias("n"), kinds.alias("kinds"))
    ranked = files.withColumn("reference_id", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "file_path")))
    contents = chunks.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("_l")).select("file_path", F.col("_l.content").alias("contents"))
    if told is not None:
        contents = contents.withColumn("contents", told(F.col("contents")))
    return ranked.join(contents, "file_path", "left").select(*by, "reference_id", "file_path", "kinds", "n", "contents")


def sort_key(name: Column) -> Column:
    """A key that sorts names without regard to case and accents; characters without a Latin form sort by themselves, behind."""
    accents = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    plain = "aaaaaaceeeeiiiinooooouuuuyy"
    return F.translate(F.lower(F.trim(name)), accents, plain)


def ordered_names(rows: DataFrame, name: str, *ties: str, locale: str = "zh") -> DataFrame:
    """rows with place: their order by name in a locale's collation, where accents and case only break ties.

    In `zh` Chinese names are in the order of their pinyin, before those in Latin letters; null names come first, as empty ones. The places of all rows are one order:
    names are dealt by range, and a part's first place follows from the sizes of the parts before it."""
    key = F.collate(F.lower(F.trim(F.coalesce(name, F.lit("")))), f"{locale}_AI")
    exact = F.collate(F.trim(F.coalesce(name, F.lit(""))), locale)
    order = [F.col("_k"), F.col("_e"), F.col(name).asc_nulls_first(), *ties]
    dealt = cut(rows.withColumns({"_k": key, "_e": exact}).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()).drop("_k", "_e"))
    part = F.shiftright("_i", 33)
    sizes = sorted((r["_part"], r["n"]) for r in dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect())  # a row a partition
    before, ahead = [], 0
    for p, n in sizes:
        before.append((p, ahead))
        ahead += n
    starts = F.create_map(*[F.lit(x) for pair in before for x in pair]) if before else F.lit(None).cast("map<bigint,bigint>")
    return dealt.withColumn("place", (F.element_at(starts, part) + F.col("_i").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("_i")
