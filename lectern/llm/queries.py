"""Queries of the subpackage and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from lectern.llm import dialogue, divergence, licenses, lines, mixing, packing, pii, quality, rules, sharding, simhash, toxicity, vectors

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_mixing": mixing.query,
    "op3_embedding_dedup": vectors.query,
    "op4_pii": pii.query,
    "op5_toxicity": toxicity.query,
    "op6_hilbert_shards": sharding.query,
    "op7_quality": quality.query,
    "op8_line_dedup": lines.query,
    "op9_packing": packing.query,
    "op10_quality_rules": rules.query,
    "op11_licenses": licenses.query,
    "op12_dialogue": dialogue.query,
    "op13_divergence": divergence.query,
}

#: Only where SQL can express the operator.
SQL: dict[str, str] = {
    "op8_line_dedup": lines.SQL,
    "op11_licenses": licenses.SQL,
    "op12_dialogue": dialogue.SQL,
    "op13_divergence": divergence.SQL,
}
