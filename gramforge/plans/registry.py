"""Registered queries of the core engine, and SQL for those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import data, lm, mix, speech

MODULES = (data, lm, mix, speech)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modified Kneser-Ney trigram model of all documents."""
    return lm.modkn_model(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: _settled(sql) for m in MODULES for name, sql in m.oracle_sql().items()}


def _settled(sql: str) -> str:
    """sql with every common table expression worked out once, which keeps the planner's work small."""
    return re.sub(r"\b([a-z]\w*) AS \((?=\s*(?:SELECT|FROM|WITH)\b)", r"\1 AS MATERIALIZED (", sql)
