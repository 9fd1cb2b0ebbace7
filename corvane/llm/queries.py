"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import align, chat, decontaminate, exact_dedup, fill_middle, langid, mixing, pii, sharding, signature_tree, simhash, suffix_dedup, toxicity


def queries():
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_sharding": sharding.op2_sharding,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_simhash": simhash.op5_simhash,
        "op6_chat": chat.op6_chat,
        "op7_langid": langid.op7_langid,
        "op8_pii": pii.op8_pii,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op11_jaccard_join": signature_tree.op11_jaccard_join,
        "op12_tokenizer_alignment": align.op12_tokenizer_alignment,
        "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
    }


def oracle_sql():
    return {"op1_mixing": mixing.SQL, "op3_exact_dedup": exact_dedup.SQL, "op6_chat": chat.SQL, "op9_decontamination": decontaminate.SQL, "op10_suffix_dedup": suffix_dedup.SQL, "op13_fill_in_middle": fill_middle.SQL}
