"""The queries of this subpackage, by name, and the SQL of those that SQL can express on whole tables."""

from . import exact_dedup, language, lm, mixing, near_dedup, packing, pii, quality, repeats, secrets, sharding, trie, whitening

QUERIES = {
    "op1_line_frequency": quality.op1,
    "op2_external_shuffle": sharding.op2,
    "op3_source_mixing": mixing.op3,
    "op4_minmax_near_dedup": near_dedup.op4,
    "op5_pitman_yor_lm": lm.op5,
    "op6_min_slack_packing": packing.op6,
    "op7_word_first_language": language.op7,
    "op8_progressive_dedup": exact_dedup.op8,
    "op9_semi_markov_pii": pii.op9,
    "op10_prefix_free_repeats": repeats.op10,
    "op11_prefix_trie": trie.op11,
    "op12_entropy_secrets": secrets.op12,
    "op13_tsqr_whitening": whitening.op13,
}

ORACLE_SQL = {"op1_line_frequency": quality.OP1_SQL, "op8_progressive_dedup": exact_dedup.OP8_SQL, "op11_prefix_trie": trie.OP11_SQL}
