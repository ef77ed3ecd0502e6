"""Queries of the corpus operators, one for each, and the oracle SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    op1_chat_format,
    op2_decontamination,
    op3_hyperminhash,
    op4_license_scan,
    op5_fingerprints,
    op6_suffix_dedup,
    op7_substring_dedup,
    op8_main_text,
    op9_toxicity,
    op10_source_mix,
    op11_ranked_search,
    op12_spelling,
    op13_shards,
)

QUERIES = {
    "op1_chat_format": op1_chat_format.query,
    "op2_decontamination": op2_decontamination.query,
    "op3_hyperminhash": op3_hyperminhash.query,
    "op4_license_scan": op4_license_scan.query,
    "op5_fingerprints": op5_fingerprints.query,
    "op6_suffix_dedup": op6_suffix_dedup.query,
    "op7_substring_dedup": op7_substring_dedup.query,
    "op8_main_text": op8_main_text.query,
    "op9_toxicity": op9_toxicity.query,
    "op10_source_mix": op10_source_mix.query,
    "op11_ranked_search": op11_ranked_search.query,
    "op12_spelling": op12_spelling.query,
    "op13_shards": op13_shards.query,
}

#: The others are tested against brute force, exact round trips or held-out accuracy.
ORACLES: dict[str, str] = {
    "op4_license_scan": op4_license_scan.ORACLE,
    "op10_source_mix": op10_source_mix.ORACLE,
    "op11_ranked_search": op11_ranked_search.ORACLE,
    "op12_spelling": op12_spelling.ORACLE,
    "op13_shards": op13_shards.ORACLE,
}
