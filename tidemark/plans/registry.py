"""Queries of the registry-monitoring part and their DuckDB equivalents."""

from __future__ import annotations

from tidemark.plans import alerts, assess, bulletin, contract, ingest, leads, lifecycle, marks, polls, rules, runs, spec, stream
from tidemark.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "alerts", "assess", "bulletin", "contract", "ingest", "leads", "lifecycle", "marks", "polls", "rules", "runs", "spec", "stream"]
