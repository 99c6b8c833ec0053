"""How well a text answers a question of a certain kind: one that asks how long, or one that asks what came of it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """The question's wording, what a text has to hold, and bonuses (words of the question or none, pattern in the text, score)."""

    question: str
    text: str
    bonuses: Sequence[tuple[str, str, float]] = ()


# Wordings and scores of both kinds.
DURATION = Rule(
    r"(?i)\b(?:duration|how\s+long|lead[-\s]?times?|shipment\s+lead[-\s]?times?)\b",
    r"(?i)\b(?:\d+(?:[.,]\d+)?\s*(?:-|–|—|to)\s*)?\d+(?:[.,]\d+)?\s*(?:months?|mths?|weeks?|wks?|days?)\b",
    (("shipment", r"\b(?:ship|shipment|shipping|shipped)\b", 0.5), ("depot", "depot", 0.5), ("shipment", "packag", 0.25), ("lead", "lead", 0.25)),
)
IMPACT = Rule(
    r"(?i)\b(?:consequences?|impacts?|effects?|outcomes?|results?|resulting|resulted)\b",
    r"(?i)\b(?:impacts?|consequences?|outcomes?|results?)\b",
    (
        ("physical flow", "physical flow", 0.5), ("netherlands", "netherlands", 0.5), ("manufactur", "manufactur", 0.25), ("submission", r"\b(?:submission|review|approval|bla)\b", 0.25),
        ("", r"\b(?:wrong|questioned|re-?label|ndc)\b", 0.25),
    ),
)
#: The signals of support that the rules give.
RULES = {"duration_answer_match": DURATION, "impact_answer_match": IMPACT}


def answer_match(question: Column, text: Column, rule: Rule) -> Column:
    """0, or 1 and the bonuses, for a text that answers the kind of question that a rule is about. Null questions and texts give 0."""
    q, t = (F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")) for c in (question, text))
    score = F.lit(1.0)
    for asked, pattern, more in rule.bonuses:
        here = F.regexp_like(t, F.lit(pattern))
        score = score + F.when(here & F.contains(q, F.lit(asked)) if asked else here, more).otherwise(0.0)
    return F.when(question.rlike(rule.question) & text.rlike(rule.text), score).otherwise(0.0)
