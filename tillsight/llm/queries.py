"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from tillsight.llm import (bpe, decontaminate, filter_audit, line_dedup, packing, quality_classifier, quality_rules, repeats,
                            secrets, sharding, simhash, spelling, toxicity)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_sharding": sharding.op4_sharding,
    "op5_suffix_array_dedup": repeats.op5_suffix_array_dedup,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_packing": packing.op7_packing,
    "op8_secret_scans": secrets.op8_secret_scans,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_bpe": bpe.op13_bpe,
}
ORACLE = {"op1_line_dedup": line_dedup.ORACLE, "op11_spelling_variants": spelling.ORACLE,
          "op12_filter_audit": filter_audit.ORACLE}
