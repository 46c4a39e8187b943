"""All registered queries: importing the modules fills the registry."""

from lendgrain.plans import (  # noqa: F401
    decision_queries,
    network_queries,
    portfolio_queries,
    verify_queries,
    filing_queries,
    prose_queries,
    statement_queries,
    stream_queries,
)
from lendgrain.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
