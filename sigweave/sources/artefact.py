"""An artefact that is merged by id, run after run: only the buckets that a run touches are written again.

Rows lie in `rows/run=R/bucket=B`, dealt by a hash of their id; `state/run=R` lists for every bucket the run that wrote
it last. A run writes its buckets beside the old ones and its state last, in one file, so readers see the old artefact until the
new one is whole. A run that is repeated replaces its own folder; a run that is already in the state changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.operators.ranking import first_per_key
from sigweave.session import cut

STATE = "bucket int, held bigint, buckets int, run bigint"


class Artefact:
    """Rows of `schema`, at most one per `key`; `buckets` is fixed by the first run (one bucket should fit some tasks)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def state(self) -> tuple[int | None, dict[int, int]]:
        """The last whole run, and the run that holds each bucket (one row per bucket)."""
        try:
            rows = self.spark.read.schema(STATE).parquet(f"{self.path}/state")
            last = rows.agg(F.max("run")).first()[0]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        if last is None:
            return None, {}
        held = rows.filter(F.col("run") == last).collect()
        self.buckets = held[0]["buckets"]
        return last, {r["bucket"]: r["held"] for r in held}

    def _rows(self, held: dict[int, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/run={r}/bucket={b}" for b, r in sorted(held.items())])

    def read(self) -> DataFrame:
        return self._rows(self.state()[1])

    def merge(self, new: DataFrame, run: int, order: Sequence[Column] = (), slices: int = 1) -> bool:
        """Rows of `new` replace those with their id and join the others; of equal ids in `new` the first in `order` counts.

        `run` is the caller's number of this run, larger than any before. False: it is in the artefact already.
        `slices` is the number of tasks (and files) that write a bucket.
        """
        last, held = self.state()
        if last is not None and run <= last:
            return False
        names = [f.name for f in self.schema]
        rest = [F.xxhash64(*names)] if order else [F.xxhash64(*names), *[F.col(n) for n in names if n != self.key]]
        one = first_per_key(new.select(*names).filter(F.col(self.key).isNotNull()), [self.key], [*order, *rest], [n for n in names if n != self.key])
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        one = cut(one.select(*names).withColumn("bucket", bucket))
        touched = [r["bucket"] for r in one.select("bucket").distinct().collect()]  # at most `buckets` numbers
        old = self._rows({b: held[b] for b in touched if b in held}).withColumn("bucket", bucket)
        merged = old.join(one.select(self.key), self.key, "left_anti").select(*names, "bucket").unionByName(one)
        dealt = merged.repartition(max(1, len(touched) * slices), "bucket", F.pmod(F.xxhash64(F.lit(1), self.key), F.lit(slices)))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/run={run}")
        now = held | dict.fromkeys(touched, run)
        rows = [(b, r, self.buckets) for b, r in sorted(now.items())]
        state = self.spark.createDataFrame(rows, "bucket int, held bigint, buckets int")
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/run={run}")
        return True
