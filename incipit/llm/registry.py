"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from incipit.llm import ann, bpe, chat_format, hard_negatives, jaccard_join, licenses, mixing, prefix_trie, quality, secrets, simhash, url_filters, warc

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_quality": quality.op2_quality,
    "op3_simhash": simhash.op3_simhash,
    "op4_ann": ann.op4_ann,
    "op5_licenses": licenses.op5_licenses,
    "op6_warc": warc.op6_warc,
    "op7_bpe": bpe.op7_bpe,
    "op8_mixing": mixing.op8_mixing,
    "op9_secrets": secrets.op9_secrets,
    "op10_url_filters": url_filters.op10_url_filters,
    "op11_jaccard_join": jaccard_join.op11_jaccard_join,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {
    "op1_chat_format": chat_format.oracle(),
    "op5_licenses": licenses.oracle(),
    "op6_warc": warc.oracle(),
    "op8_mixing": mixing.oracle(),
    "op10_url_filters": url_filters.oracle(),
    "op12_hard_negatives": hard_negatives.oracle(),
    "op13_prefix_trie": prefix_trie.oracle(),
}
