"""Queries over the test tables, each with SQL that gives the same answer."""

from tripline.workload import alerting, detection, enrichment, jobs, parsing, streams  # noqa: F401
from tripline.workload.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
