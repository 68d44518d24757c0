"""Every query of the engine's own operators, with its SQL counterpart."""

from __future__ import annotations

from guardspark.plans import classify, configured, documented, extend, flow, govern, ledger, midstream, wire  # noqa: F401
from guardspark.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
