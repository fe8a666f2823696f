"""The corpus queries by name, with SQL for those that SQL can express."""

from __future__ import annotations

from gapwise.llm import collocations, exact_dedup, fill_middle, language_id, license_scan, lm_scoring, mixing, ngram_join, packing, quality_pu, quality_rules, secret_scan, sharding

QUERIES = {
    "op1_language_hierarchy": language_id.op1_language_hierarchy,
    "op10_signature_tree_join": ngram_join.op10_signature_tree_join,
    "op11_collocations": collocations.op11_collocations,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_quality_pu": quality_pu.op13_quality_pu,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_bounded_ring": sharding.op3_bounded_ring,
    "op4_poisson_mix": mixing.op4_poisson_mix,
    "op5_license_rules": license_scan.op5_license_rules,
    "op6_elias_fano_lm": lm_scoring.op6_elias_fano_lm,
    "op7_secret_owners": secret_scan.op7_secret_owners,
    "op8_mixture_packing": packing.op8_mixture_packing,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
}
ORACLES = {
    "op7_secret_owners": secret_scan.SQL,
    "op10_signature_tree_join": ngram_join.SQL,
    "op11_collocations": collocations.SQL,
    "op12_fill_middle": fill_middle.SQL,
    "op4_poisson_mix": mixing.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
}
