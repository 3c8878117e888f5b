"""Registry of named queries: a Spark callable and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(x: str, d: int = 6) -> str:
    """Half-up rounding in SQL, the same arithmetic as `functions.scores.rnd`."""
    return f"(floor(({x})*1e{d}+0.5)/1e{d})"


def with_(ctes: list[str], final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


def typed(sql: str, types: dict[str, str]) -> str:
    """The same result with some columns cast."""
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in types.items())
    return f"SELECT * REPLACE ({casts}) FROM (\n{sql}\n)"
