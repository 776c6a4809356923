"""Queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from versetide.llm import alignment, bpe, decontaminate, exact_dedup, jaccard_join, language, licenses, prefix_trie, quality, secrets, sharding, suffix_dedup, url_rules

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_shard": sharding.op2_shard,
    "op3_language": language.op3_language,
    "language_of_pages": language.language_of_pages,
    "op4_quality": quality.op4_quality,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_licences": licenses.op6_licences,
    "op7_secrets": secrets.op7_secrets,
    "op8_bpe": bpe.op8_bpe,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_url_filter": url_rules.op10_url_filter,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_alignment": alignment.op12_alignment,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
}

ORACLE = {
    "op4_quality": quality.ORACLE,
    "op10_url_filter": url_rules.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_exact_dedup": exact_dedup.ORACLE,
}
