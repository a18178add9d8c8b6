"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .clustering import OP13_SQL, op13_dual_tree_lloyd
from .decontaminate import OP6_SQL, op6_decontaminate
from .jaccard import OP5_SQL, op5_jaccard_rtree
from .minhash import OP12_SQL, op12_tensored_minhash
from .packing import op10_pattern_packing
from .quality import op2_quality_gam
from .resampling import OP11_SQL, op11_importance_resampling
from .search import op9_bm25_top10
from .sharding import op4_external_shuffle
from .suffix_dedup import op1_suffix_dedup
from .token_files import op7_separator_scan, op8_feistel_order
from .toxicity import op3_toxicity_trees


def queries():
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_quality_gam": op2_quality_gam,
        "op3_toxicity_trees": op3_toxicity_trees,
        "op4_external_shuffle": op4_external_shuffle,
        "op5_jaccard_rtree": op5_jaccard_rtree,
        "op6_decontaminate": op6_decontaminate,
        "op7_separator_scan": op7_separator_scan,
        "op8_feistel_order": op8_feistel_order,
        "op9_bm25_top10": op9_bm25_top10,
        "op10_pattern_packing": op10_pattern_packing,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_tensored_minhash": op12_tensored_minhash,
        "op13_dual_tree_lloyd": op13_dual_tree_lloyd,
    }


def oracle_sql():
    return {"op5_jaccard_rtree": OP5_SQL, "op6_decontaminate": OP6_SQL, "op11_importance_resampling": OP11_SQL, "op12_tensored_minhash": OP12_SQL, "op13_dual_tree_lloyd": OP13_SQL}
