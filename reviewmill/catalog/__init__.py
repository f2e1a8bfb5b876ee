"""Registered queries, each with the SQL that DuckDB runs on the same tables."""

from reviewmill.catalog.registry import ORACLES, QUERIES  # noqa: F401
from reviewmill.catalog import columns, files, reports, search, streams, tables  # noqa: F401
