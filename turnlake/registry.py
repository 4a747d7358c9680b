"""All queries over the driver's tables, by name, with their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}
FLAGSHIP = "iv_time_profile"


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame; sql: the same rows from DuckDB."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add



from turnlake.plans import aggregates, intervals, joins, metrics, sampling, scans, sources, text  # noqa: E402, F401
