"""The queries opN_<name> of this subpackage and the DuckDB SQL of those that have any."""

from corvine.llm import chunk_dedup, decontaminate, kneser_ney, language_id, mixing, near_dup, quality_rules, repeats, secret_scan, url_reputation

QUERIES = {
    "op1_url_reputation": url_reputation.query,
    "op2_near_dup": near_dup.query,
    "op3_decontaminate": decontaminate.query,
    "op4_mixing": mixing.query,
    "op5_quality_rules": quality_rules.query,
    "op6_kneser_ney": kneser_ney.query,
    "op7_chunk_dedup": chunk_dedup.query,
    "op8_language_id": language_id.query,
    "op9_secret_scan": secret_scan.query,
    "op10_repeats": repeats.query,
}

ORACLE_SQL = {
    "op1_url_reputation": url_reputation.SQL,
    "op2_near_dup": near_dup.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op5_quality_rules": quality_rules.SQL,
    "op10_repeats": repeats.SQL,
}
