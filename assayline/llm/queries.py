"""The corpus queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayline.llm import ann, decontaminate, extract, linededup, mixing, neardup, periodic, pieces, quality, tokens, toxicity, variants, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_rotated_codes": ann.op3_rotated_codes,
    "op4_warc": warc.op4_warc,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_token_output": tokens.op6_token_output,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_chosen_path": neardup.op8_chosen_path,
    "op9_html_extraction": extract.op9_html_extraction,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_spelling_variants": variants.op11_spelling_variants,
    "op12_sentencepiece": pieces.op12_sentencepiece,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {"op1_mix_sources": mixing.sql()}
