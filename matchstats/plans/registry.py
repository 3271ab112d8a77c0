"""All queries of the library with their SQL: importing a module of queries adds them to the tables of core."""

from __future__ import annotations

from matchstats.plans import analysis, core, streams, wide  # noqa: F401

QUERIES, SQL = core.QUERIES, core.SQL
