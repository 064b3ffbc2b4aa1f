"""Names of queries with their builders and SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a builder (spark, sf_dir) -> DataFrame under a name, with the SQL it is checked against."""

    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.strip()
        return f

    return wrap
