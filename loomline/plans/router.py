"""Modes of retrieval, and the plan that answers a question in one of them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers
from ..operators import search, shaping
from ..operators.tracing import Trace, cut_at

MODES = ("local", "global", "hybrid", "naive", "mix", "bypass")
# How questions of each kind are worded.
_BINARY = r"^(?:is|are|was|were|do|does|did|can|could|should|would|has|have|had|will) "
_ENUMERATION = r"\b(?:what|which)\s+(?:are|were)\s+(?:the\s+)?(?:\d+\s+)?(?:(?:key|main|primary|major|important)\s+)?(?:categories|types|steps|phases|reasons|risks|issues|drivers|benefits|consequences|impacts|outcomes)\b|\bhow many\b|\b(?:list|lists|enumerate|enumeration)\b"
_COMPARISON = r"\bcompare\b|\bcomparison\b|\bdifference\b|\bversus\b|\bvs\.?\b|\bover time\b|\bhistory\b"
_CONSEQUENCE = r"\bconsequences?\b|\bimpacts?\b|\boutcomes?\b|\bwhat happened\b|\bresulted?\b"
_SIGNIFICANCE = r"\b(?:significance|importance)\b"
_PROJECT = r"\b(?:project\s+management|critical\s+path|collaboration|coordination|dependenc(?:y|ies)|stakeholders?|portfolio|program|readiness)\b"
_MITIGATION = r"\bmitigate\b|\bmitigation\b|\bput in place\b|\bimplemented?\b|\bprevent(?:ed|ing|ion)?\b|\baddress(?:ed|ing)?\b|\brecommended step\b"
_RISK_FORMAT = r"\b(?:syntax|phrase|phrasing|wording)\b.*\brisk\b|\brisk\b.*\b(?:syntax|phrase|phrasing|wording)\b"
_MATERIAL = r"\bprovide the link\b|\blink to the material\b"
_SOURCE = (
    r"\baccording to\b|\bbased on (?:the )?.{0,120}\b(?:presentation|report|document|deck|slide|dossier|file)\b|\b(?:in|from) (?:the )?.{0,120}\b(?:presentation|report|document|deck|slide|dossier|file)\b|\b\w+\.(?:pdf|pptx?|docx?|md|txt)\b"
)
_LESSONS = r"\blessons? learned\b"
_CHOICE = r"\bwhat\b|\bwhich\b|\bshould\b"
_DOSE = r"\bdose(?:[-\s]?ranging)?\b"
TOKEN = r"[a-z0-9]+(?:[._/-][a-z0-9]+)*"


def plain_question(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def intent(text: Column) -> Column:
    """struct<kind, chunks, per_document, expand, mode>: the kind of a question, how many chunks it needs in all and of one document (0: no advice),
    whether an answer from a single document may take more of it, and the mode that suits it. The first case that holds counts."""
    q = plain_question(text)
    has = q.rlike
    consequence, significance, enumeration, comparison, binary = has(_CONSEQUENCE), has(_SIGNIFICANCE), has(_ENUMERATION), has(_COMPARISON), has(_BINARY)
    mitigation, source = has(_MITIGATION), (has(_LESSONS) & ~enumeration) | has(_SOURCE)
    choice = F.contains(q, F.lit(" or ")) & ~binary & ~enumeration & ~comparison & has(_CHOICE)
    cases = (
        (q == "", ("default", 0, 0, False, "mix")),
        (F.contains(q, F.lit("mabel")) & has(_DOSE), ("single_fact", 4, 2, True, "mix")),
        ((consequence | significance) & has(_PROJECT), ("consequence", 8, 3, True, "mix")),
        (consequence | (significance & ~source), ("consequence", 6, 2, True, "mix")),
        (mitigation & has(r"\btechnology issue\b"), ("mitigation", 5, 2, True, "mix")),
        (mitigation, ("mitigation", 5, 2, False, "global")),
        (has(_RISK_FORMAT), ("risk_format", 4, 2, True, "global")),
        (has(_MATERIAL), ("material_lookup", 4, 1, True, "hybrid")),
        (source, ("source_reference", 6, 3, True, "hybrid")),
        (binary & ~comparison, ("binary", 5, 2, True, "hybrid")),
        (enumeration & F.contains(q, F.lit("lessons learned")), ("enumeration", 8, 3, True, "hybrid")),
        (enumeration, ("enumeration", 6, 2, True, "naive")),
        (comparison, ("comparison", 7, 2, True, "mix")),
        (choice, ("single_fact", 4, 1, False, "mix")),
        (F.size(F.array_distinct(F.regexp_extract_all(q, F.lit(f"({TOKEN})"), 1))) <= 5, ("single_fact", 4, 2, False, "mix")),
    )
    out = F
    for when, (kind, chunks, per, expand, mode) in cases:
        out = out.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(chunks).alias("chunks"), F.lit(per).alias("per_document"), F.lit(expand).alias("expand"), F.lit(mode).alias("mode")))
    return out.otherwise(F.struct(F.lit("default").alias("kind"), F.lit(0).alias("chunks"), F.lit(0).alias("per_document"), F.lit(False).alias("expand"), F.lit("mix").alias("mode")))


# Wordings that ask for entities of certain types, in order.
PREFERRED = (
    (r"^(?:who is|who are|who was|who were|who founded|who leads|who runs|who manages|who heads)\b", ("Person", "Organization")),
    (r"\b(?:which|what)\s+(?:company|companies|organization|organizations|firm|agency|institution|institutions)\b", ("Organization",)),
    (r"\bwho (?:founded|owns|manufactures|makes|produces|develops|sells|markets|sponsored|approved)\b", ("Person", "Organization")),
    (r"^(?:where|where is|where was|where did|where does)\b", ("Location",)),
    (r"\b(?:which|what)\s+(?:product|products|model|models|drug|drugs|technology|technologies|device|devices)\b", ("Product", "Technology")),
    (r"\b(?:what is the mechanism|how does it work|how does .* work|what is the process|what are the steps)\b", ("Method", "Concept")),
    (r"^(?:when (?:was|were|did|does)|in what year|what year)\b", ("Event",)),
)


def preferred_types(text: Column) -> Column:
    """The types of entity that a question asks for; empty if it does not say."""
    q, out = plain_question(text), F
    for pattern, types in PREFERRED:
        out = out.when(q.rlike(pattern), F.lit(list(types)))
    return out.otherwise(F.array().cast("array<string>"))


def mode_of(question: str, asked: str = "mix") -> str:
    """The mode that is used: comparisons always mix."""
    if asked not in MODES:
        raise ValueError(f"no such mode: {asked}")
    return "mix" if re.search(_COMPARISON, question.lower()) else asked


def shaped(ranked: DataFrame, question: str, terms: Sequence[str], k: int, budget: int = 8000, source: str = "mixed", rerank_floor: float | None = None, lexical_weight: float = 0.2, diversity: float = 0.7, trace: Trace | None = None) -> DataFrame:
    """(q, chunk_id, id, rank, and the rank of each stage): ranked chunks after retrieval, as they go into a prompt. A trace gets the rows of each stage.

    ranked: (q, chunk_id, doc, content, rank, score and any signals of support). In turn: the floor of reranking scores, the lexical boost, the order by support,
    the caps in all and of a document that the kind of question asks for, diversity, support again, and the token budget of chunks as JSON. All lists of q are
    worked on side by side."""
    by = ["q"]
    stages: list[tuple[str, DataFrame]] = [("merge_rank", ranked)]
    now = ranked if rerank_floor is None else shaping.above_floor(ranked, "score", rerank_floor)
    weight = max(lexical_weight, 0.75) if any(" " in t for t in terms) else lexical_weight
    if terms:
        now = shaping.lexical_boost(now, terms, "content", "rank", by, weight).withColumn("rank", F.col("new_rank")).drop("new_rank", "base", "lexical", "final")
    signals = {name: answers.answer_match(F.lit(question), F.col("content"), rule) for name, rule in answers.RULES.items() if name not in now.columns}
    now = cut_at(trace, "lexical", now.withColumns(signals))
    stages.append(("lexical_rank", now))
    now = shaping.support_order(now, by, "rank", "doc").withColumn("rank", F.col("support_rank")).drop("support_rank")
    kind, chunks, per, expand, _ = profile(now.sparkSession, question)
    limit = min(k, chunks) if chunks and source in ("naive", "vector", "hybrid") else k
    if not chunks:
        limit = min(limit, shaping.chunk_limit(len(re.findall(TOKEN, question.lower())), k))
    per = per or max(2, limit // 5)
    protected = F.when(F.col("focused") >= 1, min(limit, max(per, 5))) if limit > per else None
    now = cut_at(trace, "per_document", shaping.cap_per_document(now, "doc", "rank", per, limit, by, protected, expand))
    stages.append(("per_document_rank", now))
    if diversity < 1:
        order = shaping.mmr(now.withColumn("_r", 1.0 / F.col("rank")), "q", "chunk_id", "content", "_r", diversity, limit)
        now = now.drop("rank").join(order, ["q", "chunk_id"])
    now = cut_at(trace, "diversity", shaping.support_order(now, by, "rank", "doc").withColumn("rank", F.col("support_rank")).drop("support_rank"))
    stages.append(("mmr_rank", now))
    now = now.withColumn("tokens", shaping.json_tokens(["chunk_id", "doc", "content"]))
    kept = shaping.numbered(shaping.within_budget(now, "tokens", [F.col("rank")], budget, by), by, "rank")
    if trace is not None:
        kept = trace.cut("chunks", kept, F.col("tokens"))
    stages.append(("token_rank", kept))
    return kept.select("q", "chunk_id", "id", "rank").join(shaping.stage_ranks(stages, by, "chunk_id"), ["q", "chunk_id"])


def profile(spark: SparkSession, question: str) -> tuple[str, int, int, bool, str]:
    """The intent of one question."""
    return tuple(spark.range(1).select(intent(F.lit(question)).alias("i")).first().i)


def retrieve(question: str, chunks: DataFrame, vectors: DataFrame, links: DataFrame, vector: Sequence[float], terms: Sequence[str], mode: str = "mix", k: int = 10, budget: int = 8000, trace: Trace | None = None) -> DataFrame:
    """(chunk_id, sources, score, rank, id and the rank of each stage) for a question.

    chunks (chunk_id, doc, content), vectors (chunk_id, embedding), links (entity, chunk_id). naive reads vectors and text; local takes the chunks of the entities that the
    nearest chunks are linked with, global those of the best linked entities; hybrid and mix take both, mix with the naive legs too; bypass reads nothing.
    The legs' chunks are one list, weighted by leg, which is then shaped. A trace gets the rows of each leg and stage."""
    used = mode_of(question, mode)
    near = search.vector_topk(vectors, vector, 2 * k, "chunk_id")
    legs: list[tuple[str, DataFrame]] = []
    if used in ("naive", "mix"):
        legs.append(("vector", near.select("chunk_id", "rank")))
        if terms:
            legs.append(("text", search.text_topk(chunks, terms, 2 * k, "chunk_id", "content").select("chunk_id", "rank")))
    order = lambda *c: F.row_number().over(Window.orderBy(*c))
    if used in ("local", "hybrid", "mix"):
        entities = links.join(near.select("chunk_id"), "chunk_id", "left_semi").groupBy("entity").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "entity").limit(2 * k)
        if trace is not None:
            entities = trace.cut("entities", entities)
        around = links.join(entities, "entity").groupBy("chunk_id").agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), "chunk_id").limit(2 * k)
        legs.append(("entity", around.withColumn("rank", order(F.desc("_c"), "chunk_id")).select("chunk_id", "rank")))
    if used in ("global", "hybrid", "mix"):
        top = links.groupBy("entity").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "entity").limit(2 * k)
        if trace is not None:
            top = trace.cut("relations", top)
        linked = links.join(top, "entity").groupBy("chunk_id").agg(F.sum("_n").alias("_c")).orderBy(F.desc("_c"), "chunk_id").limit(2 * k)
        legs.append(("relation", linked.withColumn("rank", order(F.desc("_c"), "chunk_id")).select("chunk_id", "rank")))
    if trace is not None:
        legs = [(name, trace.cut(name, leg)) for name, leg in legs]
    if not legs:
        names = ("merge_rank", "lexical_rank", "per_document_rank", "mmr_rank", "token_rank")
        return chunks.where("false").select("chunk_id", F.lit("").alias("sources"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"), F.lit("").alias("id"), *[F.lit(0).alias(n) for n in names])
    weights = {"vector": 0.4, "text": 0.3, "entity": 0.2, "relation": 0.1}
    parts = [(name, leg.select("chunk_id", (1.0 / (search.RRF_K + F.col("rank"))).alias("score"))) for name, leg in legs]
    merged = cut_at(trace, "merged", shaping.merge_sources(parts, "chunk_id", "score", weights).join(chunks.select("chunk_id", "doc", "content"), "chunk_id").withColumn("rank", order(F.desc("score"), "chunk_id")).withColumn("q", F.lit(0)))
    out = shaped(merged, question, terms, k, budget, source=used, trace=trace)
    return merged.select("chunk_id", "sources", "score").join(out.drop("q"), "chunk_id")


def explained(question: str, *args, mode: str = "mix", **more) -> DataFrame:
    """(position, stage, rows, tokens, seconds) of a retrieval (arguments as retrieve's): each leg and stage in order, and last `answerable`, whose one row says that chunks were found."""
    trace = Trace()
    out = retrieve(question, *args, mode=mode, trace=trace, **more)
    trace.stages.append(("answerable", int(any(s == "chunks" and n for s, n, _, _ in trace.stages)), sum(t for s, _, t, _ in trace.stages if s == "chunks"), round(sum((x[3] for x in trace.stages), 0.0), 3)))
    return trace.frame(out.sparkSession)
