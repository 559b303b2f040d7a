"""Queries of this subpackage and their SQL, for the entry file."""

from __future__ import annotations

from maskwright.llm import lang_id, license_scan, mixing, near_dedup, packing, quality, substring_dedup, topk, url_filter, warc


def queries() -> dict:
    return {
        "op1_exact_topk": topk.query_topk,
        "op2_source_mixing": mixing.query_mixing,
        "op3_near_dedup": near_dedup.query_near_dedup,
        "op4_url_filter": url_filter.query_urls,
        "op5_quality_rules": quality.query_quality,
        "op6_substring_dedup": substring_dedup.query_substring_dedup,
        "op7_best_fit_packing": packing.query_packing,
        "op8_language_id": lang_id.query_lang_id,
        "op9_licence_scan": license_scan.query_licences,
        "op10_warc_bundles": warc.query_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_topk": topk.TOPK_SQL,
        "op2_source_mixing": mixing.MIXING_SQL,
        "op3_near_dedup": near_dedup.NEAR_SQL,
        "op4_url_filter": url_filter.urls_sql(),
        "op5_quality_rules": quality.QUALITY_SQL,
        "op10_warc_bundles": warc.WARC_SQL,
    }
