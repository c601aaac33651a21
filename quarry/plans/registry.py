"""Registered queries and their SQL oracles, filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir), with the SQL that gives the same rows."""

    def keep(function):
        _QUERIES[name] = function
        if sql is not None:
            _ORACLES[name] = sql
        return function

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quarry.plans import economics, gates, ledgers, profile, structures  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLES)
