"""Registry of the engine's driver queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import answers, audit, closing, folds, frames, gateway, identity, ledger, metrics, pump, records, redaction, secrets, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _plan in (metrics, redaction, identity, audit, streams, folds, frames, gateway, closing, secrets, records, pump, ledger, answers):
    QUERIES.update(_plan.QUERIES)
    ORACLE_SQL.update(_plan.ORACLE_SQL)
