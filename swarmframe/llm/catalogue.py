"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

MODULES = (
    "license_scan", "language_id", "near_dedup", "mixing", "sharding",
    "packing", "token_counts", "exact_topk", "quality_rules", "chat_format",
)


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"{__package__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{name}"), "ORACLE_SQL", {})
    return found
