"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from heddle.tables import SQL, Views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Views; sql follows the common table expressions of heddle.tables."""

    def put(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            body = sql.strip()
            ORACLES[name] = f"WITH RECURSIVE {SQL.strip()}{body if body.startswith(',') else ' ' + body}"
        return f

    return put
