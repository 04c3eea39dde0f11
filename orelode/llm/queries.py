"""The registered queries of this package, and their SQL twins."""

from __future__ import annotations

from . import archive, decontamination, embedding_dedup, filter_audit, lexical_search, line_dedup, minhash_dedup, packing, quality_rules, secret_scan, source_mix, token_counts, toxicity

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_source_mix": source_mix.op3_source_mix,
    "op4_content_archive": archive.op4_content_archive,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_token_rollup": token_counts.op8_token_rollup,
    "op9_minhash_dedup": minhash_dedup.op9_minhash_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_decontamination": decontamination.op12_decontamination,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL = {
    "op3_source_mix": source_mix.SOURCE_MIX_SQL,
    "op4_content_archive": archive.ARCHIVE_SQL,
    "op5_line_dedup": line_dedup.LINE_DEDUP_SQL,
    "op11_lexical_search": lexical_search.LEXICAL_SEARCH_SQL,
    "op12_decontamination": decontamination.DECONTAMINATION_SQL,
    "op13_filter_audit": filter_audit.FILTER_AUDIT_SQL,
}
