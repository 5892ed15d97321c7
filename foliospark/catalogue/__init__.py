"""Registered queries by area: what each operator returns over the driver's tables, and its SQL."""

from __future__ import annotations

import importlib

from foliospark.catalogue.registry import ORACLES, QUERIES, register

AREAS = ("text", "segments", "ranking", "reading", "corpus", "records", "screening", "extraction", "verification", "review", "writing", "ledger")
FLAGSHIP = "q_reader_retrieve"

for _area in AREAS:
    importlib.import_module(f"foliospark.catalogue.{_area}")

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "register"]
