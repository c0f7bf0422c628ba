"""Queries of the corpus operators, by name, and their SQL."""

from __future__ import annotations

from . import ball_kmeans, conv_toxicity, language_id, line_quality, merkle_proofs, pii_disclosure, secret_scan, simhash_dedup, source_mix, template_decontam, token_orc, url_models, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_template_decontam": template_decontam.query,
    "op3_token_orc": token_orc.query,
    "op4_url_models": url_models.query,
    "op5_source_mix": source_mix.query,
    "op6_secret_scan": secret_scan.query,
    "op7_line_quality": line_quality.query,
    "op8_language_id": language_id.query,
    "op9_pii_disclosure": pii_disclosure.query,
    "op10_simhash_dedup": simhash_dedup.query,
    "op11_ball_kmeans": ball_kmeans.query,
    "op12_conv_toxicity": conv_toxicity.query,
    "op13_merkle_proofs": merkle_proofs.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.ORACLE_SQL,
    "op5_source_mix": source_mix.ORACLE_SQL,
    "op7_line_quality": line_quality.ORACLE_SQL,
    "op11_ball_kmeans": ball_kmeans.ORACLE_SQL,
    "op13_merkle_proofs": merkle_proofs.ORACLE_SQL,
}
