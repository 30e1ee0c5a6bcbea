"""All registered queries of the library itself, by name, and their SQL."""

from __future__ import annotations

from siftspark.plans import analytics, cases, domain, extended, further, relational  # noqa: F401  registers
from siftspark.plans.core import ORACLES, QUERIES

FLAGSHIP = "d2_family_scores"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
