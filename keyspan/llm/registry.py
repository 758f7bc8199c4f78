"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from keyspan.llm import decontaminate, html_text, language_id, licences, mixing, near_dup, sharding, url_filter, vector_dup, warc


def queries() -> dict:
    return {f.__name__: f for f in (vector_dup.op1_cover_tree_vector_dedup, decontaminate.op2_cgk_decontamination, language_id.op3_string_kernel_language_id, html_text.op4_site_style_tree_extraction, sharding.op5_feistel_sharding, url_filter.op6_bloom_cascade_url_filter, near_dup.op7_minhash_near_dedup, licences.op8_licence_scan, mixing.op9_temperature_mixing, warc.op10_warc_round_trip)}


def oracle_sql() -> dict:
    return {"op1_cover_tree_vector_dedup": vector_dup.OP1_SQL, "op7_minhash_near_dedup": near_dup.OP7_SQL, "op6_bloom_cascade_url_filter": url_filter.OP6_SQL, "op10_warc_round_trip": warc.OP10_SQL}
