"""Queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, exact_dedup, fill_middle, fingerprints, html_text, importance, jaccard_join, maxent_lm, mixing, quality, suffix_dedup, token_files, tool_calls


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_tool_calls": tool_calls.op2_tool_calls,
        "op3_token_files": token_files.op3_token_files,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_bpe": bpe.op6_bpe,
        "op7_quality": quality.op7_quality,
        "op8_maxent_lm": maxent_lm.op8_maxent_lm,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_imatch": fingerprints.op10_imatch,
        "op11_fill_middle": fill_middle.op11_fill_middle,
        "op12_html_text": html_text.op12_html_text,
        "op13_resample": importance.op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact_dedup.SQL, "op11_fill_middle": fill_middle.SQL, "op13_resample": importance.SQL}
