"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from lanewise.llm import chat, conversation_repair, decontaminate, filter_audit, jaccard_join, minmax_dedup, quality_knn, quality_rules, sentencepiece_scan, suffix_dedup, tokens, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_sentencepiece": sentencepiece_scan.op3_sentencepiece,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_ngram_jaccard_join": jaccard_join.op5_ngram_jaccard_join,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_suffix_array_dedup": suffix_dedup.op8_suffix_array_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality_classifier": quality_knn.op10_quality_classifier,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_minhash_dedup": minmax_dedup.op12_minhash_dedup,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
SQL = {"op1_warc": warc.OP1_SQL, "op5_ngram_jaccard_join": jaccard_join.OP5_SQL, "op6_quality_rules": quality_rules.OP6_SQL, "op7_decontamination": decontaminate.OP7_SQL, "op11_filter_audit": filter_audit.OP11_SQL, "op12_minhash_dedup": minmax_dedup.OP12_SQL}
