"""All registered queries."""

from __future__ import annotations

from dnslens.plans import q_core, q_experiments, q_inventory, q_policies, q_reports, q_streaming  # noqa: F401
from dnslens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
