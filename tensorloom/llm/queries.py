"""The queries of this subpackage and their SQL, for the driver's entry file."""

from __future__ import annotations

from tensorloom.llm import bpe, conversations, decontaminate, exact_dedup, hard_negatives, language, line_dedup, quality, secrets, sharding, simhash, substring_dedup, suffix_dedup


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_bpe": bpe.op3_bpe,
        "op4_simhash": simhash.op4_simhash,
        "op5_language": language.op5_language,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_secrets": secrets.op7_secrets,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_quality_rules": quality.op11_quality_rules,
        "op12_conversation_repair": conversations.op12_conversation_repair,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.OP2_SQL,
        "op8_substring_dedup": substring_dedup.OP8_SQL,
        "op11_quality_rules": quality.OP11_SQL,
        "op13_hard_negatives": hard_negatives.OP13_SQL,
    }
