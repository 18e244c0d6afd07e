"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from tidemark.llm import chat, hard_negatives, html, mixing, phrases, pieces, quality, resampling, simhash, toxicity, vector_dedup, warc, webp

_MODULES = (pieces, mixing, warc, quality, toxicity, chat, html, webp, simhash, phrases, resampling, hard_negatives, vector_dedup)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
