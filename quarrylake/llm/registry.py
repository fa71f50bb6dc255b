"""The queries of this subpackage, and their SQL where SQL can express them."""

from quarrylake.llm import decontamination, html_extraction, jaccard_join, line_dedup, mixing, pii, prefix_trie, projected_search, simhash, substring_dedup, suffix_tree_lm, toxicity, turn_repair


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_pii": pii.op2_pii,
        "op3_simhash": simhash.op3_simhash,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_html_extraction": html_extraction.op5_html_extraction,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_mixing": mixing.op7_mixing,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_lm_scoring": suffix_tree_lm.op10_lm_scoring,
        "op11_nearest": projected_search.op11_nearest,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_turn_repair": turn_repair.op13_turn_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.ORACLE_OP1,
        "op6_jaccard_join": jaccard_join.ORACLE_OP6,
        "op8_line_dedup": line_dedup.ORACLE_OP8,
        "op9_substring_dedup": substring_dedup.ORACLE_OP9,
        "op12_prefix_trie": prefix_trie.ORACLE_OP12,
        "op13_turn_repair": turn_repair.ORACLE_OP13,
    }
