"""Named queries: a function of the catalog, and the SQL it is compared to where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.catalog import PREFIX, Catalog

QUERIES: dict[str, Callable[[Catalog], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, prefix: bool = True):
    """Registers a query; sql may name the catalog's relations (prefix) or the raw tables alone."""

    def add(f: Callable[[Catalog], DataFrame]):
        QUERIES[name] = f
        if sql:
            text = sql.strip()
            ORACLES[name] = (PREFIX.rstrip() + ", " + text[5:] if text.startswith("with ") else PREFIX + text) if prefix else text
        return f

    return add
