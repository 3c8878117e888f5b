"""What both vector searches share: which rows take part, matrices from Arrow columns, the merge of partial top lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def finite(v: Column) -> Column:
    """The array is not null and holds finite numbers only."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """Rows of a list column whose lists are equally long."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = c.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(c), -1).astype(dtype, copy=False)


def ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def top_k(partial: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query from the lists that the tasks found; at most k rows of a query leave a task."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def one_row_per_id(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Repeated ids count once: the smallest vector of an id stays."""
    return rows.groupBy(id_col).agg(F.min(vec_col).alias(vec_col))
