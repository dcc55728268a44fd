"""The registered query of each operator of this subpackage, and its SQL."""

from . import alignment, bestfit, hnsw, hostrules, jaccard, lines, mixing, packing, toxicity, trie, urllist, warc, wavelet

QUERIES = {
    "op1_toxicity_trees": toxicity.op1_toxicity_trees,
    "op2_wavelet_shards": wavelet.op2_wavelet_shards,
    "op3_host_rules": hostrules.op3_host_rules,
    "op4_concat_and_cut": packing.op4_concat_and_cut,
    "op5_entropy_balancing": mixing.op5_entropy_balancing,
    "op6_rtree_jaccard": jaccard.op6_rtree_jaccard,
    "op7_temporal_list_join": urllist.op7_temporal_list_join,
    "op8_transaction_assembly": warc.op8_transaction_assembly,
    "op9_hnsw_near_dedup": hnsw.op9_hnsw_near_dedup,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_suffix_transducer": alignment.op11_suffix_transducer,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_bin_completion": bestfit.op13_bin_completion,
}

ORACLE_SQL: dict[str, str] = {
    "op3_host_rules": hostrules.OP3_SQL,
    "op7_temporal_list_join": urllist.OP7_SQL,
    "op8_transaction_assembly": warc.OP8_SQL,
    "op10_line_dedup": lines.OP10_SQL,
    "op12_prefix_trie": trie.OP12_SQL,
}
