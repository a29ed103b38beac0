"""Names of queries, the functions that build them and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("retrieval", "graphs", "records", "online", "streams", "files", "catalog", "extras", "providers", "ingest", "curation", "encoding", "learned", "stored")


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"papyra.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"papyra.plans.{name}").ORACLES
    return found
