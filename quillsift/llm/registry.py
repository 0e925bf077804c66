"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from quillsift.llm import bpe, chat_format, collocations, fingerprint, html_extract, language_id, license_scan, near_dedup, packing, ppm, prefix_trie, quality_rules, toxicity


def queries():
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_fingerprints": fingerprint.op3_fingerprints,
        "op4_license_scan": license_scan.op4_license_scan,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_lm_scoring": ppm.op6_lm_scoring,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_html_extract": html_extract.op8_html_extract,
        "op9_chat_formatting": chat_format.op9_chat_formatting,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "op11_language_id": language_id.op11_language_id,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_collocations": collocations.op13_collocations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op2_quality_rules": quality_rules.oracle(),
        "op4_license_scan": license_scan.oracle(),
        "op9_chat_formatting": chat_format.oracle(),
        "op12_prefix_trie": prefix_trie.oracle(),
        "op13_collocations": collocations.oracle(),
    }
