"""All registered queries."""

from . import (  # noqa: F401
    assembly_queries,
    discovery_queries,
    metric_queries,
    pass_queries,
    source_queries,
    text_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
