"""The registered queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import (
    byte_bpe,
    collocations,
    conversation_repair,
    decontaminate,
    language_id,
    line_dedup,
    ngram_join,
    packing,
    quality_model,
    quality_rules,
    secret_scan,
    token_counts,
    warc,
)


def queries() -> dict:
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_byte_bpe": byte_bpe.op2_byte_bpe,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_warc": warc.op5_warc,
        "op6_quality_model": quality_model.op6_quality_model,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_language_id": language_id.op8_language_id,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_best_fit_packing": packing.op11_best_fit_packing,
        "op12_collocations": collocations.op12_collocations,
        "op13_conversation_repair": conversation_repair.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.OP3_SQL, "op5_warc": warc.OP5_SQL, "op12_collocations": collocations.OP12_SQL}
