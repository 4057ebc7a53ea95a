"""All registered queries."""

from wardline.plans import q_detect, q_risk, q_streams, q_tables  # noqa: F401
from wardline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
