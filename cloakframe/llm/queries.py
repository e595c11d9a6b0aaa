"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from . import decontamination, exact_dedup, language_id, line_dedup, lm_scoring, ngram_jaccard, packing, passage_dedup, quality, suffix_dedup, toxicity

QUERIES = {
    "op1_lm_scoring": lm_scoring.query,
    "op2_ngram_jaccard": ngram_jaccard.query,
    "op3_line_dedup": line_dedup.query,
    "op3_passage_dedup": passage_dedup.query,
    "op4_decontamination": decontamination.query,
    "op5_language_id": language_id.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_quality": quality.query,
    "op8_packing": packing.query,
    "op9_toxicity": toxicity.query,
    "op10_exact_dedup": exact_dedup.query,
}

ORACLES = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op3_passage_dedup": passage_dedup.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
