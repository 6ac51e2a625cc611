"""Queries: operators bound to the driver tables, each with its SQL oracle where one exists."""

from rungauge.plans import curation, evaluation, gate, groups, merge, messages, monitor, sequences, sources, streams  # noqa: F401  (each fills the registry)
from rungauge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
