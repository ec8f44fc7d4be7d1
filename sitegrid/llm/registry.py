"""The queries of this folder, for __spark_entry__.py."""

from __future__ import annotations

from sitegrid.llm.alignment import op12_alignment
from sitegrid.llm.byte_bpe import op3_byte_bpe
from sitegrid.llm.decontaminate import op6_decontaminate
from sitegrid.llm.extract import op10_extract
from sitegrid.llm.filter_audit import op11_filter_audit
from sitegrid.llm.katz import op5_katz
from sitegrid.llm.language import op7_language
from sitegrid.llm.near_dedup import op1_near_dedup
from sitegrid.llm.neighbours import op9_nearest
from sitegrid.llm.oracles import ORACLES
from sitegrid.llm.packing import op13_best_fit
from sitegrid.llm.reshard import op8_reshard
from sitegrid.llm.token_counts import op4_token_counts
from sitegrid.llm.toxicity import op2_toxicity


def queries() -> dict:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_token_counts": op4_token_counts,
        "op5_katz": op5_katz,
        "op6_decontaminate": op6_decontaminate,
        "op7_language": op7_language,
        "op8_reshard": op8_reshard,
        "op9_nearest": op9_nearest,
        "op10_extract": op10_extract,
        "op11_filter_audit": op11_filter_audit,
        "op12_alignment": op12_alignment,
        "op13_best_fit": op13_best_fit,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
