"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op2_decontaminate
from .html import op1_html
from .jaccard import op7_jaccard
from .licenses import op9_licenses
from .lm_score import op6_lm_score
from .oracle import oracle_sql
from .pieces import op3_pieces
from .quality import op10_quality_rules
from .secrets import op8_secrets
from .substrings import op4_substrings
from .token_files import op5_token_files

__all__ = ["oracle_sql", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_html, op2_decontaminate, op3_pieces, op4_substrings, op5_token_files, op6_lm_score, op7_jaccard, op8_secrets, op9_licenses, op10_quality_rules]
    return {f.__name__: f for f in found}


