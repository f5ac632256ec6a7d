"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from geoloom.llm import decontamination, fixity, langid, licences, packing, passages, pieces, quality, sharding, simhash, toxicity, variants, whitening


def queries():
    return {
        "op1_substring_dedup": passages.op1_substring_dedup,
        "op2_language_id": langid.op2_language_id,
        "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
        "op4_benchmark_decontamination": decontamination.op4_benchmark_decontamination,
        "op5_harmonic_packing": packing.op5_harmonic_packing,
        "op6_rendezvous_sharding": sharding.op6_rendezvous_sharding,
        "op7_licence_scan": licences.op7_licence_scan,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_merkle_fixity": fixity.op9_merkle_fixity,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_feast_whitening": whitening.op11_feast_whitening,
        "op12_spelling_variants": variants.op12_spelling_variants,
        "op13_sentencepiece": pieces.op13_sentencepiece,
    }


def oracle_sql():
    return {
        "op4_benchmark_decontamination": decontamination.OP4_SQL,
        "op6_rendezvous_sharding": sharding.OP6_SQL,
        "op7_licence_scan": licences.OP7_SQL,
        "op9_merkle_fixity": fixity.OP9_SQL,
        "op12_spelling_variants": variants.OP12_SQL,
    }
