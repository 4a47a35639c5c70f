"""The corpus operators' queries and the SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import conversations, decontaminate, exact_dedup, filter_audit, language_id, mixing, near_dedup, pii, suffix_dedup, token_counts, token_files, toxicity, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_warc": warc.op6_warc,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_language_id": language_id.op10_language_id,
    "op11_token_files": token_files.op11_token_files,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_conversation_repair": conversations.op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op6_warc": warc.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
