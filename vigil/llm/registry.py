"""The corpus operators' queries: name -> (function, SQL or None)."""

from __future__ import annotations

from vigil.llm import byte_bpe, codes, contamination, exact_dedup, lm_score, mixing, near_dedup, quality, site_style, substring_dedup, token_counts, toxicity, variants


def registry() -> dict:
    return {
        "op1_token_counts": (token_counts.op1_token_counts, None),
        "op2_substring_dedup": (substring_dedup.op2_substring_dedup, substring_dedup.SQL),
        "op3_lm_score": (lm_score.op3_lm_score, None),
        "op4_html_text": (site_style.op4_html_text, None),
        "op5_byte_bpe": (byte_bpe.op5_byte_bpe, None),
        "op6_quality_rules": (quality.op6_quality_rules, quality.SQL),
        "op7_toxicity": (toxicity.op7_toxicity, None),
        "op8_exact_dedup": (exact_dedup.op8_exact_dedup, exact_dedup.SQL),
        "op9_mix_sources": (mixing.op9_mix_sources, mixing.SQL),
        "op10_near_dedup": (near_dedup.op10_near_dedup, None),
        "op11_decontaminate": (contamination.op11_decontaminate, contamination.SQL),
        "op12_spelling_variants": (variants.op12_spelling_variants, None),
        "op13_vector_codes": (codes.op13_vector_codes, codes.SQL),
    }
