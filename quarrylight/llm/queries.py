"""The queries of this subpackage, by the names they are registered under."""

from __future__ import annotations

from quarrylight.llm import classifier, exact_topk, html_text, lexical, lm_scoring, mixing, ngram_join, order_minhash, packing, quality_rules, resampling, token_counts, url_filters

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_url_filters": url_filters.op4_url_filters,
    "op5_packing": packing.op5_packing,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_mixing": mixing.op7_mixing,
    "op8_html_text": html_text.op8_html_text,
    "op9_quality_classifier": classifier.op9_quality_classifier,
    "op10_exact_topk": exact_topk.op10_exact_topk,
    "op11_order_minhash": order_minhash.op11_order_minhash,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_lexical_search": lexical.op13_lexical_search,
}

ORACLES = {
    "op1_ngram_join": ngram_join.ORACLE_SQL,
    "op2_quality_rules": quality_rules.ORACLE_SQL,
    "op10_exact_topk": exact_topk.ORACLE_SQL,
    "op13_lexical_search": lexical.ORACLE_SQL,
}
