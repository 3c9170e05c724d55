"""Queries of the operators for training data. None of them can be put into one SQL statement; tests hold brute-force versions."""

from __future__ import annotations

from chatlode.llm import conversations, duplicates, encoding, packing, pairs, pii, sentences, subjects


def queries():
    return {
        "p1_found": pii.p1_found,
        "p1_masked": pii.p1_masked,
        "p2_found": pairs.p2_found,
        "p3_found": subjects.p3_found,
        "p3_composition": subjects.p3_composition,
        "p5_found": duplicates.p5_found,
        "p5_counts": duplicates.p5_counts,
        "p6_found": conversations.p6_found,
        "p6_conversations": conversations.p6_conversations,
        "p7_ids": encoding.p7_ids,
        "p8_containers": packing.p8_containers,
        "p8_unused": packing.p8_unused,
        "p9_found": sentences.p9_found,
    }


def oracle_sql():
    return {}
