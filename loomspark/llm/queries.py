"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10

QUERIES = {f.__name__: f for f in (op1.op1_token_counts, op2.op2_quality_rules, op3.op3_toxicity, op4.op4_best_fit_packing, op5.op5_embedding_near_dedup, op6.op6_byte_bpe, op7.op7_simhash_near_dedup, op8.op8_quality_classifier, op9.op9_pii, op10.op10_token_id_output)}
ORACLES = {"op2_quality_rules": op2.ORACLE_SQL}
