"""All named queries over the catalog, with the SQL they are compared to."""

from __future__ import annotations

from .operators import evaluation, labels, listeners, matching, personas, profile_report, profiles, quality, recommend, serving, statistics, transforms, windows  # noqa: F401
from .operators.registry import ORACLES, QUERIES
from .operators.reports import REPORTS
from .sources.catalog import Catalog


def queries() -> dict:
    """Every query of the engine as a function of (spark, folder)."""
    found = {name: (lambda spark, folder, r=report: r.frame(Catalog(spark, folder))) for name, report in REPORTS.items()}
    return found | {name: (lambda spark, folder, f=f: f(Catalog(spark, folder))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: report.sql() for name, report in REPORTS.items()} | ORACLES
