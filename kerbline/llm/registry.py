"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, gru_lm, html_extraction, jaccard_join, language_id, merkle_manifest, mixing, near_dup, quality_rules, sharding, token_alignment, url_filter, warc

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_html_extraction": html_extraction.op3_html_extraction,
    "op4_mixing": mixing.op4_mixing,
    "op5_sharding": sharding.op5_sharding,
    "op6_warc": warc.op6_warc,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_language_id": language_id.op8_language_id,
    "op9_lm_score": gru_lm.op9_lm_score,
    "op10_near_dup": near_dup.op10_near_dup,
    "op11_jaccard_join": jaccard_join.op11_jaccard_join,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_token_alignment": token_alignment.op13_token_alignment,
    "mixing_sizes": mixing.op4_sizes,
}
ORACLES = {
    "op1_decontamination": decontamination.OP1_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op12_merkle_manifest": merkle_manifest.OP12_SQL,
    "mixing_sizes": mixing.OP4_SIZES_SQL,
}
