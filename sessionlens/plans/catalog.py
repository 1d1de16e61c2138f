"""All queries of the session operators, with the SQL that checks them."""

from __future__ import annotations

from . import card_queries, gate_queries, interval_queries, ledger_queries, live_queries, lookup_queries, pack_queries, pairing_queries, recorder_queries, rule_queries, session_queries, source_queries, spoken_queries, store_queries, stream_queries, text_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
