"""Query catalogue of the core: every query callable and, where SQL can say it, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamarind.operators import spatial, units
from tamarind.plans import relational

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = relational.QUERIES | {
    "p6_found": units.p6_found,
    "p7_found": spatial.p7_found,
}
ORACLES: dict[str, str] = relational.ORACLES | {}
