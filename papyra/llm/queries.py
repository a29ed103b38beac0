"""All queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("phrases", "language", "simhash", "sharding", "licenses", "urls", "mixing", "quality", "decontamination", "warc", "prefix_trie", "alignment", "tokens")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"papyra.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
