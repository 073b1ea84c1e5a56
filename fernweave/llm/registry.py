"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from fernweave.llm import binary, decontam, exact_dedup, mixing, quality, secrets, simhash, substrings, tokens, toxicity


def queries() -> dict:
    return {
        "op1_benchmark_decontamination": decontam.op1_benchmark_decontamination,
        "op2_token_binary": binary.op2_token_binary,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_quality_classifier": quality.op4_quality_classifier,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_token_counts": tokens.op6_token_counts,
        "op7_mix_sources": mixing.op7_mix_sources,
        "op8_simhash_dedup": simhash.op8_simhash_dedup,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_suffix_dedup": substrings.op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_scan": secrets.OP3_SQL, "op7_mix_sources": mixing.OP7_SQL, "op9_exact_dedup": exact_dedup.OP9_SQL}
