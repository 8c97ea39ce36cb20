"""Queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
from heddle.llm import decontaminate, importance, jaccard_join, lexical, licenses, line_dedup, mixing, near_dedup, quality, tokens, toxicity, urls, warc

QUERIES = {
    "op1_crf_toxicity": toxicity.op1_crf_toxicity,
    "op2_edit_aware_token_counts": tokens.op2_edit_aware_token_counts,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_cgk_decontamination": decontaminate.op4_cgk_decontamination,
    "op5_pfair_mixing": mixing.op5_pfair_mixing,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_setsketch_near_dedup": near_dedup.op7_setsketch_near_dedup,
    "op8_warc_round_trip": warc.op8_warc_round_trip,
    "op9_suffix_line_dedup": line_dedup.op9_suffix_line_dedup,
    "op10_url_filter": urls.op10_url_filter,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_ngram_jaccard_join": jaccard_join.op12_ngram_jaccard_join,
    "op13_ranked_search": lexical.op13_ranked_search,
    "pipeline": corpus_pipeline.run,
}
#: SQL can't express models (1, 10), a tokenizer (2), a randomized search (4) and the stages over them; tests hold those against Python.
ORACLES = {
    "op3_license_scan": licenses.ORACLE,
    "op5_pfair_mixing": mixing.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op7_setsketch_near_dedup": near_dedup.ORACLE,
    "op8_warc_round_trip": warc.ORACLE,
    "op9_suffix_line_dedup": line_dedup.ORACLE,
    "op11_importance_resampling": importance.ORACLE,
    "op12_ngram_jaccard_join": jaccard_join.ORACLE,
    "op13_ranked_search": lexical.ORACLE,
}
