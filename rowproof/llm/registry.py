"""Queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from . import bpe, exact_dedup, hard_negatives, languages, lm_scores, mixing, near_dedup, neighbours, pii, quality, repeats, urls, whitening


def queries():
    return {
        "op1_pii": pii.op1_pii,
        "op2_quality": quality.op2_quality,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_bpe": bpe.op4_bpe,
        "op5_repeats": repeats.op5_repeats,
        "op6_lm_scores": lm_scores.op6_lm_scores,
        "op7_urls": urls.op7_urls,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_neighbours": neighbours.op9_neighbours,
        "op10_mixing": mixing.op10_mixing,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_languages": languages.op12_languages,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql():
    return {
        "op8_exact_dedup": exact_dedup.ORACLE_SQL,
        "op10_mixing": mixing.ORACLE_SQL,
    }
