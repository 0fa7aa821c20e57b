"""The subpackage's queries and their SQL, by the names under which they are registered."""

from __future__ import annotations

from veilworks.llm import chat, decontamination, fingerprints, mixing, neardup, quality, sharding, substrings, tokens, toxicity

QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_minhash_neardup": neardup.op2_minhash_neardup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sharding": sharding.op4_sharding,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_chat_format": chat.op8_chat_format,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality": quality.op10_quality,
}

SQL = {
    "op1_substring_dedup": substrings.OP1_SQL,
    "op2_minhash_neardup": neardup.OP2_SQL,
    "op4_sharding": sharding.OP4_SQL,
    "op8_chat_format": chat.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
}
