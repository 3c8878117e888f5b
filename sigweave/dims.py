"""Literal knowledge tables, rendered once as a Spark relation and once as an SQL CTE.

A `Dim` is a fixed, hand-sized list of rows, so its byte size is known when the
plan is made and a broadcast of it is bounded by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DIM_ROWS = 100_000


def _lit(v: object, kind: str, spark: bool) -> str:
    sql_type = {"string": "STRING" if spark else "VARCHAR", "int": "INT", "bigint": "BIGINT", "double": "DOUBLE"}[kind]
    if v is None:
        return f"CAST(NULL AS {sql_type})"
    if kind == "string":
        text = str(v)
        if spark:
            text = text.replace("\\", "\\\\").replace("'", "\\'")
        else:
            text = text.replace("'", "''")
        return f"'{text}'"
    return f"CAST({v} AS {sql_type})"


class Dim:
    """A small literal table: `cols` is a list of (name, type)."""

    def __init__(self, name: str, cols: Sequence[tuple[str, str]], rows: Sequence[tuple]):
        if len(rows) > MAX_DIM_ROWS:
            raise ValueError(f"{name}: {len(rows)} rows is not a literal table; load it as a DataFrame")
        self.name, self.cols, self.rows = name, list(cols), list(rows)

    def _values(self, spark: bool) -> str:
        return ", ".join(
            "(" + ", ".join(_lit(v, k, spark) for v, (_, k) in zip(r, self.cols)) + ")" for r in self.rows
        )

    def df(self, spark: SparkSession) -> DataFrame:
        names = ", ".join(c for c, _ in self.cols)
        return spark.sql(f"SELECT * FROM VALUES {self._values(True)} AS {self.name}({names})")

    def small(self, spark: SparkSession) -> DataFrame:
        """The table with a broadcast hint; safe because the row count is a literal."""
        return F.broadcast(self.df(spark))

    def cte(self) -> str:
        names = ", ".join(c for c, _ in self.cols)
        return f"{self.name}({names}) AS (VALUES {self._values(False)})"

    def column(self, name: str) -> list:
        i = [c for c, _ in self.cols].index(name)
        return [r[i] for r in self.rows]

    def distinct(self, name: str) -> list:
        return list(dict.fromkeys(self.column(name)))


#: bytes of rows (as text) up to which a measured table is broadcast
BROADCAST_BYTES = 64 << 20


def checked_broadcast(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Broadcast `df` only if its rows take at most `max_bytes` bytes; otherwise leave the
    join to the planner (shuffle join with adaptive skew splitting). Results are the same.

    The size is summed over the rows as they are, so wide texts count in full. Pass stored or cheap frames.
    """
    bound = BROADCAST_BYTES if max_bytes is None else max_bytes
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= bound else df
