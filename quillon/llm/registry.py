"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op2_bpe_codec
from .decontaminate import op1_decontamination
from .html_text import op7_html_text
from .jaccard_join import op5_jaccard_join
from .language_id import op3_language_id
from .license_scan import op8_license_scan, op8_sql
from .line_dedup import op9_line_dedup
from .quality_rules import OP10_SQL, op10_quality_rules
from .token_counts import op6_token_counts
from .warc import op4_warc_derivatives

QUERIES = (op1_decontamination, op2_bpe_codec, op3_language_id, op4_warc_derivatives, op5_jaccard_join, op6_token_counts, op7_html_text, op8_license_scan, op9_line_dedup, op10_quality_rules)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op8_license_scan": op8_sql(), "op10_quality_rules": OP10_SQL}
