"""Registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from loomsift.llm.hardneg import OP11_SQL, op11_hard_negatives
from loomsift.llm.lattice import op4_sentencepiece_sampling
from loomsift.llm.lm import op7_language_model
from loomsift.llm.neighbours import OP5_SQL, op5_nearest_neighbours
from loomsift.llm.packing import op1_best_fit_packing
from loomsift.llm.pii import op6_personal_data
from loomsift.llm.quality import op9_quality_rules
from loomsift.llm.secrets import op2_secret_scans
from loomsift.llm.simhash import op8_simhash
from loomsift.llm.suffixes import op10_suffix_dedup
from loomsift.llm.tokenfiles import op3_token_files
from loomsift.llm.toxicity import op12_toxicity
from loomsift.llm.whitening import op13_whitening


def queries():
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_secret_scans": op2_secret_scans,
        "op3_token_files": op3_token_files,
        "op4_sentencepiece_sampling": op4_sentencepiece_sampling,
        "op5_nearest_neighbours": op5_nearest_neighbours,
        "op6_personal_data": op6_personal_data,
        "op7_language_model": op7_language_model,
        "op8_simhash": op8_simhash,
        "op9_quality_rules": op9_quality_rules,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_toxicity": op12_toxicity,
        "op13_whitening": op13_whitening,
    }


def oracles() -> dict[str, str]:
    return {"op5_nearest_neighbours": OP5_SQL, "op11_hard_negatives": OP11_SQL}
