"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from ledgerloom.llm import chat, hard_negatives, html_text, media, mixing, near_duplicates, packing, periodic_runs, quality, substring_dedup, token_counts, toxicity, warc


def queries() -> dict:
    return {
        "op1_source_mixing": mixing.op1_source_mixing,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_ngram_jaccard_join": near_duplicates.op3_ngram_jaccard_join,
        "op4_warc": warc.op4_warc,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_chat_formatting": chat.op6_chat_formatting,
        "op7_media_columns": media.op7_media_columns,
        "op8_sequence_packing": packing.op8_sequence_packing,
        "op9_html_extraction": html_text.op9_html_extraction,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_substring_dedup": substring_dedup.op11_substring_dedup,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": mixing.OP1_SQL, "op4_warc": warc.OP4_SQL, "op5_quality_rules": quality.OP5_SQL, "op6_chat_formatting": chat.OP6_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL}
