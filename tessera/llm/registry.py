"""Queries over the text tables, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_wrappers, jaccard, language, licences, line_templates, mixing, neighbours, substring, token_files

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_nearest_neighbours": neighbours.op1_nearest_neighbours,
        "op2_substring_dedup": substring.op2_substring_dedup,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_licence_scan": licences.op4_licence_scan,
        "op5_html_extraction": html_wrappers.op5_html_extraction,
        "op6_language_id": language.op6_language_id,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_mixing": mixing.op8_mixing,
        "op9_token_files": token_files.op9_token_files,
        "op10_line_dedup": line_templates.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring.OP2_SQL,
        "op3_jaccard_join": jaccard.OP3_SQL,
        "op7_decontamination": decontaminate.OP7_SQL,
        "op8_mixing": mixing.OP8_SQL,
    }
