"""All queries outside the llm folder, by name, and their SQL."""

from __future__ import annotations

from . import extracts, neighbourhood, statistics, tabulation

MODULES = (tabulation, neighbourhood, statistics, extracts)
QUERIES: dict = {name: f for m in MODULES for name, f in m.Q.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.S.items()}
