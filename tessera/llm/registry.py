"""The subpackage's queries by name, and SQL for those that it can express."""

from __future__ import annotations

import corpus_pipeline

from . import attribution, bpe, decontaminate, linededup, neardup, pitman_yor, quality, substrings, toxicity, urls

QUERIES = {
    "op1_url_filter": urls.query,
    "op2_line_dedup": linededup.query,
    "op3_quality_rules": quality.query,
    "op4_decontamination": decontaminate.query,
    "op5_pitman_yor": pitman_yor.query,
    "op6_token_counts": attribution.query,
    "op7_minhash": neardup.query,
    "op8_toxicity": toxicity.query,
    "op9_byte_bpe": bpe.query,
    "op10_substring_dedup": substrings.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {"op2_line_dedup": linededup.SQL, "op4_decontamination": decontaminate.SQL}
