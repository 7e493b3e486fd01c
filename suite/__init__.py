"""Registered queries: each a Spark job over the given tables with its SQL twin."""

from suite.common import REGISTRY
from suite import matching, operations, profiling, retrieval, streams  # noqa: F401

__all__ = ["REGISTRY"]
