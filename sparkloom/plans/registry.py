"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import analytics, catalogs, corpus, indexes, language_models, retrieval

_PLANS = (retrieval, corpus, analytics, language_models, catalogs, indexes)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
SQL: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
