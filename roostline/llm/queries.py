"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from roostline.llm import (
    decontaminate, html_text, kd_shards, license_scan, line_dedup, mixing, near_dup, nearest, quality, ranked_search, spelling, toxicity, url_filter,
)

# Name: query and its SQL, None where SQL cannot express it.
QUERIES = {
    "op1_html_text": (html_text.query, None),
    "op2_license_scan": (license_scan.query, None),
    "op3_nearest": (nearest.query, None),
    "op4_decontaminate": (decontaminate.query, decontaminate.SQL),
    "op5_near_dup": (near_dup.query, near_dup.SQL),
    "op6_kd_shards": (kd_shards.query, None),
    "op7_quality": (quality.query, None),
    "op8_mixing": (mixing.query, None),
    "op9_line_dedup": (line_dedup.query, line_dedup.SQL),
    "op10_toxicity": (toxicity.query, None),
    "op11_ranked_search": (ranked_search.query, ranked_search.SQL),
    "op12_spelling": (spelling.query, spelling.SQL),
    "op13_url_filter": (url_filter.query, url_filter.SQL),
}
