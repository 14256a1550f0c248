"""Queries of this subpackage for the driver: a name, its function, its SQL."""

from tracemill.llm import cotraining, html_text, lexical, merkle, packing, pieces, preferences, quality_rules, simhash, spotsigs, substring_dedup, token_counts, warc

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_cotraining": cotraining.op3_cotraining,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_html_extraction": html_text.op5_html_extraction,
    "op6_packing": packing.op6_packing,
    "op7_simhash": simhash.op7_simhash,
    "op8_preferences": preferences.op8_preferences,
    "op9_warc": warc.op9_warc,
    "op10_spotsigs": spotsigs.op10_spotsigs,
    "op11_merkle": merkle.op11_merkle,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_lexical": lexical.op13_lexical,
    "preference_pairs": preferences.preference_pairs,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.SQL,
    "op8_preferences": preferences.SQL,
    "op9_warc": warc.SQL,
    "op11_merkle": merkle.SQL,
    "op13_lexical": lexical.SQL,
    "preference_pairs": preferences.PAIRS_SQL,
}
