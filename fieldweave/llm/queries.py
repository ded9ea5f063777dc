"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import cotraining, line_dedup, lm, mixing, ngram_join, packing, quality, substring_dedup, topk, toxicity

QUERIES = {
    "op1_classifier_chain": toxicity.query,
    "op2_maxent_lm": lm.query,
    "op3_line_set_join": line_dedup.query,
    "op4_norm_sorted_topk": topk.query,
    "op5_rule_ledger": quality.query,
    "op6_debruijn_dedup": substring_dedup.query,
    "op7_best_fit_packing": packing.query,
    "op8_pareto_mix": mixing.query,
    "op9_signature_tree_join": ngram_join.query,
    "op10_cotraining": cotraining.query,
    "rule_ablations": quality.ablation_query,
}
ORACLES = {
    "op3_line_set_join": line_dedup.ORACLE,
    "op4_norm_sorted_topk": topk.ORACLE,
    "op5_rule_ledger": quality.ORACLE,
    "op6_debruijn_dedup": substring_dedup.ORACLE,
    "op8_pareto_mix": mixing.ORACLE,
    "rule_ablations": quality.ABLATION_ORACLE,
}
