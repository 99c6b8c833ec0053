"""The queries of this package and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .backoff import OP7_SQL, op7_backoff
from .codes import OP12_SQL, op12_codes
from .decontaminate import OP8_SQL, op8_decontaminate
from .language import op2_language_id
from .licenses import OP6_SQL, op6_licenses
from .neardup import OP5_SQL, op5_near_duplicates
from .neighbours import op1_nearest
from .packing import op9_pack
from .pii import op3_pii
from .quality import op4_quality
from .spelling import OP13_SQL, op13_spelling
from .substrings import OP10_SQL, op10_substring_dedup
from .winnowing import op11_fingerprints

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_language_id": op2_language_id,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_licenses": op6_licenses,
    "op7_backoff": op7_backoff,
    "op8_decontaminate": op8_decontaminate,
    "op9_pack": op9_pack,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_fingerprints": op11_fingerprints,
    "op12_codes": op12_codes,
    "op13_spelling": op13_spelling,
}
SQL: dict[str, str] = {
    "op5_near_duplicates": OP5_SQL,
    "op6_licenses": OP6_SQL,
    "op7_backoff": OP7_SQL,
    "op8_decontaminate": OP8_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op12_codes": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
