"""The queries of this subpackage and their SQL, where SQL can say the same."""

from __future__ import annotations

from . import bpe, chat, decontaminate, jaccard_join, quality_model, quality_rules, sharding, suffix_dedup, toxicity, url_filter


def queries():
    return {
        "op1_decontaminate": decontaminate.op1,
        "op2_quality_rules": quality_rules.op2,
        "op3_bpe": bpe.op3,
        "op4_suffix_dedup": suffix_dedup.op4,
        "op5_chat_format": chat.op5,
        "op6_jaccard_join": jaccard_join.op6,
        "op7_sharding": sharding.op7,
        "op8_toxicity": toxicity.op8,
        "op9_quality_model": quality_model.op9,
        "op10_url_filter": url_filter.op10,
    }


def oracle_sql():
    return {
        "op1_decontaminate": decontaminate.OP1_SQL,
        "op2_quality_rules": quality_rules.OP2_SQL,
        "op5_chat_format": chat.OP5_SQL,
        "op10_url_filter": url_filter.OP10_SQL,
    }
