"""The thin queries of this subpackage by name, and DuckDB SQL where it can express one."""

from __future__ import annotations

from tessera.llm import bpe, chat, decontaminate, divergence, html_text, linededup, quality, rules, simhash, tokencount, tokenfile, toxicity, trie

QUERIES = {
    "op1_token_counts": tokencount.op1_token_counts,
    "op2_bpe_round_trip": bpe.op2_bpe_round_trip,
    "op3_benchmark_overlap": decontaminate.op3_benchmark_overlap,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_html_text": html_text.op5_html_text,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_simhash_near_duplicates": simhash.op8_simhash_near_duplicates,
    "op9_token_file": tokenfile.op9_token_file,
    "op10_quality_rules": rules.op10_quality_rules,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_line_dedup": linededup.op12_line_dedup,
    "op13_source_divergence": divergence.op13_source_divergence,
}
#: The other queries are held against brute force, exact round trips or held-out labels by tests.
ORACLES: dict[str, str] = {"op10_quality_rules": rules.ORACLE, "op12_line_dedup": linededup.ORACLE, "op13_source_divergence": divergence.ORACLE}
