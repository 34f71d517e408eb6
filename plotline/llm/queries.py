"""Registered queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from . import (best_fit_packing, dart_minhash, duckdb_bpe, hypergeometric_shards, importance_resampling, kdtree_search,
               language_id, license_scan, line_winnowing, rmq_search, skip_chain_crf, spelling_variants,
               template_decontamination)

QUERIES = {
    "op1_language_id": language_id.op1,
    "op2_license_scan": license_scan.op2,
    "op3_hypergeometric_shards": hypergeometric_shards.op3,
    "op4_importance_resampling": importance_resampling.op4,
    "op5_line_winnowing": line_winnowing.op5,
    "op6_template_decontamination": template_decontamination.op6,
    "op7_best_fit_packing": best_fit_packing.op7,
    "op8_kdtree_top_k": kdtree_search.op8,
    "op9_dart_minhash": dart_minhash.op9,
    "op10_skip_chain_crf": skip_chain_crf.op10,
    "op11_rmq_search": rmq_search.op11,
    "op12_duckdb_bpe": duckdb_bpe.op12,
    "op13_spelling_variants": spelling_variants.op13,
}

ORACLE = {"op5_line_winnowing": line_winnowing.OP5_SQL, "op8_kdtree_top_k": kdtree_search.OP8_SQL,
          "op11_rmq_search": rmq_search.OP11_SQL}
