"""Operators of a training-data pipeline; nothing else in the library imports this package."""

from tallychain.llm import (
    chat,
    decontaminate,
    divergence,
    filter_audit,
    jaccard_join,
    packing,
    quality_model,
    quality_rules,
    secret_scan,
    sharding,
    suffix_dedup,
    token_files,
    url_filter,
)

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_packing": packing.op2_packing,
    "op3_token_files": token_files.op3_token_files,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_chat_tree": chat.op5_chat_tree,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_quality_model": quality_model.op7_quality_model,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_sharding": sharding.op13_sharding,
}
ORACLES = {
    "op6_decontaminate": decontaminate.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op10_jaccard_join": jaccard_join.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_filter_audit": filter_audit.SQL,
}
