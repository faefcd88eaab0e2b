"""Every query of the library by name, with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from cloakwork.plans import calls, detection, options, outputs, scores, services

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (detection, outputs, calls, scores, services, options):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
