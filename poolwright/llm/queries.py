"""The registered queries of this subpackage and their SQL."""

from poolwright.llm import (
    exact_dedup,
    minmax_dedup,
    mixing,
    packing,
    prefix_trie,
    quality_gam,
    quality_rules,
    sharding,
    spelling,
    suffix_dedup,
    token_count,
    toxicity,
    url_filter,
)

QUERIES = {
    "op1_sharding": sharding.op1,
    "op2_exact_dedup": exact_dedup.op2,
    "op3_packing": packing.op3,
    "op4_suffix_dedup": suffix_dedup.op4,
    "op5_quality_gam": quality_gam.op5,
    "op6_mixing": mixing.op6,
    "op7_url_filter": url_filter.op7,
    "op8_quality_rules": quality_rules.op8,
    "op9_token_count": token_count.op9,
    "op10_minmax_dedup": minmax_dedup.op10,
    "op11_prefix_trie": prefix_trie.op11,
    "op12_spelling": spelling.op12,
    "op13_toxicity": toxicity.op13,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op6_mixing": mixing.SQL,
    "op10_minmax_dedup": minmax_dedup.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_spelling": spelling.SQL,
}
