"""The subpackage's queries and the SQL that checks them."""

from __future__ import annotations

from waywarden.llm import chat, hmm, media, mixing, near_dup, packing, pii, quality, sharding, token_files


def queries():
    return {
        "op1_line_frequency": quality.op1,
        "op2_pii_spans": pii.op2,
        "op3_hmm_score": hmm.op3,
        "op4_arrow_tokens": token_files.op4,
        "op5_entropy_mixing": mixing.op5,
        "op6_chat_format": chat.op6,
        "op7_feistel_shards": sharding.op7,
        "op8_bayes_near_dup": near_dup.op8,
        "op9_online_packing": packing.op9,
        "op10_webp_media": media.op10,
    }


def oracle_sql():
    return {
        "op1_line_frequency": quality.ORACLE,
        "op2_pii_spans": pii.ORACLE,
        "op6_chat_format": chat.ORACLE,
        "op7_feistel_shards": sharding.ORACLE,
        "op8_bayes_near_dup": near_dup.ORACLE,
    }
