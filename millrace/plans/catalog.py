"""Importing this module registers every query."""

from millrace.plans import checks, documents, observability, records, runs, scalars, shards, streams  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES  # noqa: F401
