"""Registry of the core's queries and their SQL."""

from __future__ import annotations

from .plans import problems, q_fits, q_more, q_rows, q_streams, q_tables, registry  # noqa: F401

flagship = q_tables.flagship
QUERIES: dict = {**registry.QUERIES, **problems.QUERIES}
ORACLES: dict = {**registry.ORACLES, **problems.ORACLES}
