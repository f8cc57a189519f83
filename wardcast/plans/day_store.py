"""Results kept by day, so that a later run makes only the days that are not there yet.

Each run writes a folder of its own, and a ledger then says which run holds which day. A day
counts only by its ledger line, so a run that fails adds nothing, a run that is repeated replaces its
days and doubles none, and a day without rows is known to be one.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.sources import files

_LEDGER = "day date, run string, written bigint"


def days_between(first: date, last: date) -> list[date]:
    """The days from ``first`` up to, not with, ``last``."""
    return [first + timedelta(days=i) for i in range((last - first).days)]


class DayStore:
    """Rows by day in a folder that all executors share; ``schema`` without the day."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def ledger(self) -> dict[date, tuple[str, int]]:
        """(run, when) that holds each stored day. One line for each day a run wrote."""
        if not files.names(self.spark, f"{self.path}/ledger"):
            return {}
        lines = self.spark.read.schema(_LEDGER).parquet(f"{self.path}/ledger")
        last = lines.groupBy("day").agg(F.max_by(F.struct("run", "written"), "written").alias("x"))
        return {r["day"]: (r["x"]["run"], r["x"]["written"]) for r in last.collect()}

    def missing(self, first: date, last: date, refresh: int = 0) -> list[date]:
        """Days of the range that are not stored, and its last ``refresh`` days."""
        known = self.ledger()
        return [d for d in days_between(first, last) if d not in known or d >= last - timedelta(days=refresh)]

    def put(self, rows: DataFrame, days: Iterable[date]) -> None:
        """Stores ``rows``, which have a ``day``, as all there is of ``days``."""
        days = list(days)
        run = uuid.uuid4().hex
        folder = f"{self.path}/rows/run={run}"
        try:
            # Rows of a day come together, and a day too large for a task is split.
            rows.where(F.col("day").isin(days)).hint("rebalance", "day").write.partitionBy("day").parquet(folder)
        except BaseException:
            files.remove(self.spark, folder)
            raise
        lines = [(d, run, time.time_ns()) for d in days]
        self.spark.createDataFrame(lines, _LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def get(self, first: date, last: date) -> DataFrame:
        """The stored rows of a range of days, with their ``day``."""
        known = {d: run for d, (run, _) in self.ledger().items() if first <= d < last}
        runs = sorted(set(known.values()))
        schema = f"{self.schema}, run string, day date"
        if not runs:
            return self.spark.createDataFrame([], schema).drop("run")
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/rows")
        rows = rows.parquet(*[f"{self.path}/rows/run={run}" for run in runs])
        valid = self.spark.createDataFrame(list(known.items()), "day date, run string")
        # The days are few, and their directories are pruned by this join.
        return rows.where((F.col("day") >= F.lit(first)) & (F.col("day") < F.lit(last))).join(
            F.broadcast(valid), ["day", "run"], "left_semi"
        ).drop("run")

    def tidy(self) -> None:
        """Removes runs all of whose days were replaced, and what failed runs left; not while
        a run is being written."""
        used = {f"run={run}" for run, _ in self.ledger().values()}
        for name in files.names(self.spark, f"{self.path}/rows"):
            if name not in used:
                files.remove(self.spark, f"{self.path}/rows/{name}")
