"""Registered queries of the training-data operators and their SQL."""
from __future__ import annotations

from importlib import import_module

MODULES = ("simhash", "sharding", "exact_dedup", "language", "ppm", "packing", "token_files", "warc", "spotsigs", "mixing", "tokenizer_spans", "decontamination", "fim")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"refaudit.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
