"""All queries over the given tables, by name, and the SQL that each equals where SQL can express it."""

from . import corpus, evaluation, facts, ingest, records, retrieval, scans, streams  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
