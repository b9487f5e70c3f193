"""Query registry: Spark queries and their SQL oracles."""

from . import audit, changes, durable, fits, health, ledger, meters, records, timelines, values  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
