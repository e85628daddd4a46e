"""Registry of the queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from tidecast.llm import (
    op1_cotraining,
    op2_token_records,
    op3_quality_rules,
    op4_golay_simhash,
    op5_url_filter,
    op6_repeated_substrings,
    op7_entropy_mix,
    op8_chat_masks,
    op9_decontaminate,
    op10_extendible_shards,
    op11_license_templates,
    op12_alignment,
    op13_repair,
)

QUERIES = {
    "op1_cotraining": op1_cotraining.query,
    "op2_token_records": op2_token_records.query,
    "op3_quality_rules": op3_quality_rules.query,
    "op4_golay_simhash": op4_golay_simhash.query,
    "op5_url_filter": op5_url_filter.query,
    "op6_repeated_substrings": op6_repeated_substrings.query,
    "op7_entropy_mix": op7_entropy_mix.query,
    "op8_chat_masks": op8_chat_masks.query,
    "op9_decontaminate": op9_decontaminate.query,
    "op10_extendible_shards": op10_extendible_shards.query,
    "op11_license_templates": op11_license_templates.query,
    "op12_alignment": op12_alignment.query,
    "op13_repair": op13_repair.query,
}

#: Queries without an entry (4, 5 and others) are tested by brute force.
ORACLE = {
    "op3_quality_rules": op3_quality_rules.SQL,
    "op8_chat_masks": op8_chat_masks.SQL,
    "op9_decontaminate": op9_decontaminate.SQL,
    "op10_extendible_shards": op10_extendible_shards.SQL,
    "op11_license_templates": op11_license_templates.SQL,
}
