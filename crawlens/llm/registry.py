"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from crawlens.llm import decontamination, mixing, nearest, pieces, prefix_trie, quality_model, quality_rules, secrets, simhash, spellings, substrings, suffixes, url_filter

QUERIES = {
    "op1_quality_model": quality_model.query,
    "op2_mixing": mixing.query,
    "op3_quality_rules": quality_rules.query,
    "op4_pieces": pieces.query,
    "op5_simhash": simhash.query,
    "op6_suffixes": suffixes.query,
    "op7_url_filter": url_filter.query,
    "op8_substrings": substrings.query,
    "op9_secrets": secrets.query,
    "op10_nearest": nearest.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_spellings": spellings.query,
    "op13_decontamination": decontamination.query,
}
ORACLES: dict[str, str] = {
    "op3_quality_rules": quality_rules.ORACLE,
    "op6_suffixes": suffixes.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op8_substrings": substrings.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_spellings": spellings.ORACLE,
    "op13_decontamination": decontamination.ORACLE,
}
