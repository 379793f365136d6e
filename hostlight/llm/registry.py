"""Queries and SQL of the corpus operators, for `__spark_entry__`."""

from __future__ import annotations

from . import audio, bpe, decontaminate, html_extract, jaccard_join, language_id, licences, lm_score, merkle, mixing, quality, suffix_dedup, whitening

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1,
    "op2_license_scan": licences.op2,
    "op3_suffix_array_dedup": suffix_dedup.op3,
    "op4_language_id_ppm": language_id.op4,
    "op5_bpe_forced_boundaries": bpe.op5,
    "op6_maxent_lm_score": lm_score.op6,
    "op7_chroma_fingerprints": audio.op7,
    "op8_quality_cascade": quality.op8,
    "op9_html_minimum_cut": html_extract.op9,
    "op10_hierarchical_mixing": mixing.op10,
    "op11_whitening_multiplicity": whitening.op11,
    "op12_merkle_slot_pivot": merkle.op12,
    "op13_fm_index_decontamination": decontaminate.op13,
}
SQL = {
    "op2_license_scan": licences.SQL,
    "op8_quality_cascade": quality.SQL,
    "op10_hierarchical_mixing": mixing.SQL,
    "op12_merkle_slot_pivot": merkle.SQL,
    "op13_fm_index_decontamination": decontaminate.SQL,
}
