"""All queries of the code-evidence engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from tracewright.plans import code, enrich, extraction, files, graph, guard, impact, more, relational, reports, rules, semantic  # noqa: F401  (their queries register themselves)
from tracewright.plans.base import ORACLES, QUERIES

FLAGSHIP = "e1_e6_symbol_fusion"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
