"""The core's queries and their SQL."""

from __future__ import annotations

import importlib

_NAMES = (
    "operators.identity", "operators.strings", "operators.extraction", "operators.formats", "operators.merge", "operators.sites", "operators.search", "operators.passes", "operators.candidates", "operators.understanding", "operators.spelling", "operators.pages",
    "operators.learned", "operators.usage", "operators.clicks", "operators.graph", "operators.evaluation", "operators.quality", "operators.vectors", "operators.places", "operators.answers", "streaming.epochs",
)
_MODULES = [importlib.import_module(f"webloom.{n}") for n in _NAMES]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}


def flagship(spark, d):
    """Sites found for each distinct query: fielded retrieval, blended scores and all passes over the hits."""
    return QUERIES["blended_full"](spark, d)
