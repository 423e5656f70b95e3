"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import importlib

from . import decontaminate, divergence, jaccard, licenses, packing, pii, quality, quantised, sql, token_counts, toxicity, trie, urls, warc


def pipeline(spark, sf_dir):
    """All stages of ``corpus_pipeline.py``."""
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_warc_index": warc.op3_warc_index,
    "op4_pii": pii.op4_pii,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
    "op8_url_filter": urls.op8_url_filter,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_additive_quantisation": quantised.op12_additive_quantisation,
    "op13_prefix_trie": trie.op13_prefix_trie,
    "pipeline": pipeline,
}

SQL = {
    "op7_ngram_jaccard": sql.OP7,
    "op8_url_filter": urls.OP8_SQL,
    "op9_quality_rules": sql.OP9,
    "op11_source_divergence": divergence.OP11_SQL,
    "op12_additive_quantisation": quantised.OP12_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
