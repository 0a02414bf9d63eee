"""Registry of the engine's queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "weekly_features"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers the decorated function under its name, with the SQL that DuckDB answers alike."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def load() -> None:
    from tidemark.queries import acceptance, backtest, distribution, evaluation, modelling, panel, series, states, storage, streams  # noqa: F401
