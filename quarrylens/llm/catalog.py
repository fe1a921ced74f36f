"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from quarrylens.llm import chat_format, collocations, decontamination, filter_audit, jaccard_join, language_id, license_scan, line_dedup, mixing, quality_classifier, quality_rules, suffix_tree, token_counts

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_suffix_tree": suffix_tree.query,
    "op3_decontamination": decontamination.query,
    "op4_line_dedup": line_dedup.query,
    "op5_quality_rules": quality_rules.query,
    "op6_mixing": mixing.query,
    "op7_jaccard_join": jaccard_join.query,
    "op8_token_counts": token_counts.query,
    "op9_language_id": language_id.query,
    "op10_quality_classifier": quality_classifier.query,
    "op11_filter_audit": filter_audit.query,
    "op12_chat_format": chat_format.query,
    "op13_collocations": collocations.query,
}

#: The others cannot be put in SQL; tests/llm holds them against brute force.
ORACLES = {
    "op1_license_scan": license_scan.oracle(),
    "op3_decontamination": decontamination.oracle(),
    "op4_line_dedup": line_dedup.oracle(),
    "op5_quality_rules": quality_rules.oracle(),
    "op6_mixing": mixing.oracle(),
    "op7_jaccard_join": jaccard_join.oracle(),
    "op11_filter_audit": filter_audit.oracle(),
    "op12_chat_format": chat_format.oracle(),
    "op13_collocations": collocations.oracle(),
}
