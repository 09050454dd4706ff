"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from kestrelix.llm.decontaminate import op5_benchmark_decontamination
from kestrelix.llm.language_id import op10_language_id
from kestrelix.llm.license_scan import op7_license_scan
from kestrelix.llm.line_dedup import op8_line_dedup
from kestrelix.llm.minhash import op4_minhash_near_dedup
from kestrelix.llm.oracles import ORACLES
from kestrelix.llm.packing import op1_best_fit_packing
from kestrelix.llm.quality import op6_quality_classifier
from kestrelix.llm.sharding import op3_sharding
from kestrelix.llm.substring_dedup import op9_substring_dedup
from kestrelix.llm.topk_search import op2_topk_search


def queries() -> dict:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_topk_search, op3_sharding, op4_minhash_near_dedup, op5_benchmark_decontamination, op6_quality_classifier, op7_license_scan, op8_line_dedup, op9_substring_dedup, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
