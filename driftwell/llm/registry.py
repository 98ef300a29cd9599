"""The queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import ann_tree, bagminhash, chat_format, exact_dedup, mixing, packing, quality_qda, token_files, toxicity_gru, warc
from ._stage import shipped


def queries() -> dict:
    made = {
        "op1_chat_format": chat_format.op1_chat_format,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_quality": quality_qda.op3_quality,
        "op4_mix": mixing.op4_mix,
        "op5_toxicity": toxicity_gru.op5_toxicity,
        "op6_pack": packing.op6_pack,
        "op7_warc": warc.op7_warc,
        "op8_token_files": token_files.op8_token_files,
        "op9_near_dedup": bagminhash.op9_near_dedup,
        "op10_ann": ann_tree.op10_ann,
    }
    return {name: shipped(f) for name, f in made.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat_format.OP1_SQL, "op2_exact_dedup": exact_dedup.OP2_SQL, "op7_warc": warc.OP7_SQL}
