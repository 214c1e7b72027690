"""All queries of the engine and the SQL that each must agree with."""

from __future__ import annotations

from . import modelling, screening, simulation, statistics, texts  # noqa: F401  (they register)
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "scenario_summary"
