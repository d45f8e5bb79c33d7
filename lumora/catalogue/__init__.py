"""Registered queries over the given tables, each with SQL that gives the same rows where SQL can."""

from lumora.catalogue.registry import ORACLES, QUERIES
from lumora.catalogue import bivariate, forecasts, ingest, models, reports_and_logs, tables_and_quality, timeseries, univariate  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
