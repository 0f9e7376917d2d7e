"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stintforge.sources.shipping import ship
from stintforge.sources.tables import FACT_SQL, Tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, select: str | None = None, ctes: str = "") -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a query over ``Tables``; ``select`` is the same result in SQL, over the fact relations and ``ctes``."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, root: str) -> DataFrame:
            ship(spark)
            return build(Tables(spark, root))

        QUERIES[name] = run
        if select is not None:
            ORACLE[name] = f"with {FACT_SQL}{', ' + ctes if ctes else ''} {select}"
        return build

    return register


def _load() -> None:
    from stintforge.plans import build, catalogue, events, features, linear, ordered, ratings, relational, scalar, stores  # noqa: F401


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Padded rates: see ``scl22_padded_rate``."""
    return queries()["scl22_padded_rate"](spark, root)


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
