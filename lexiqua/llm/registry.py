"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lexiqua.llm import decontaminate, html_text, importance, jaccard_join, mixing, quality, quality_classifier, token_alignment, token_counts, token_files, unit_dedup, url_filter, warc

_MODULES = (quality, token_files, mixing, decontaminate, token_counts, html_text, warc, url_filter, jaccard_join, unit_dedup, quality_classifier, token_alignment, importance)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
