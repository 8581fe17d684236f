"""The registered queries of the text operators, and their SQL."""

from . import chunk_dedup, decontamination, fingerprint, hard_negatives, html_text, lm_score, minhash_dedup, pieces, prefix_trie, sharding, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_minhash_dedup": minhash_dedup.query,
    "op2_chunk_dedup": chunk_dedup.query,
    "op3_lm_score": lm_score.query,
    "op4_decontamination": decontamination.query,
    "op5_sharding": sharding.query,
    "op6_html_text": html_text.query,
    "op7_fingerprint": fingerprint.query,
    "op8_sentencepiece": pieces.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_toxicity": toxicity.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_token_counts": token_counts.query,
}
ORACLE_SQL = {
    "op5_sharding": sharding.ORACLE,
    "op4_decontamination": decontamination.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
