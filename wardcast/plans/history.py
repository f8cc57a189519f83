"""What a run takes over from the runs before it: census movements and counted stays by day."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.config import ForecastConfig
from wardcast.functions.dates import within
from wardcast.operators import census, survival
from wardcast.plans.day_store import DayStore, days_between
from wardcast.sources import files
from wardcast.sources.tables import SourceTables


class CensusHistory:
    """Midnight movements by census day.

    What a movement says of its day does not change with the reporting day, what is known of the
    encounter does. So the movements are stored and joined with the present tags when they are
    read, and the census is the one that a run over all days makes. ``refresh`` days before
    the end are made again by every run, for movements that arrive late. ``time_type``: the
    type of the movement table's times.
    """

    def __init__(self, spark: SparkSession, path: str, refresh: int = 0, time_type: str = "timestamp_ntz"):
        self.store = DayStore(spark, path, f"csn bigint, department_name string, census_ts {time_type}, weight bigint")
        self.refresh, self.time_type = refresh, time_type

    def update(self, tables: SourceTables, days: DataFrame, cfg: ForecastConfig) -> list[date]:
        """Stores the census days that are missing, and returns which."""
        wanted = self.store.missing(cfg.usable_start, cfg.last_census_day, self.refresh)
        if wanted:
            some = days.where(F.col("day_date").isin(wanted))
            moves = census.census_moves(tables, some, min(wanted), max(wanted), cfg)
            when = F.col("census_ts").cast(self.time_type).alias("census_ts")
            key = F.col("csn").cast("bigint").alias("csn")
            counted = moves.groupBy(F.col("census_date").alias("day"), key, "department_name", when).agg(
                F.count("*").alias("weight")
            )
            self.store.put(counted, wanted)
        return wanted

    def moves(self, cfg: ForecastConfig) -> DataFrame:
        """The stored movements of the history, equal ones counted in ``weight``."""
        return self.store.get(cfg.usable_start, cfg.last_census_day).withColumnRenamed("day", "census_date")


class StayHistory:
    """Counts of stays by key and length for each day of discharge, and their sum over a window.

    Counts can be added and taken away. A later window is the stored one plus the days it
    gained minus the days it lost; only those are read. ``longest``: stays beyond that many days are
    counted together, so curves may go so far.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], longest: int):
        self.spark, self.path, self.keys, self.longest = spark, path.rstrip("/"), list(keys), longest
        texts = "".join(f"{k} string, " for k in self.keys)
        self._counts = f"{texts}_bucket int, _n bigint"
        self.store = DayStore(spark, f"{self.path}/days", self._counts)

    def update(self, stays: DataFrame, discharged: str, first: date, last: date, refresh: int = 0) -> list[date]:
        """Counts the stays of days from ``first`` to ``last`` (not with it) that are not stored."""
        wanted = self.store.missing(first, last, refresh)
        if wanted:
            left = F.col(discharged)
            day = F.to_date(left)
            length = F.greatest(F.least(F.coalesce("los", F.lit(0)), F.lit(self.longest + 1)), F.lit(0)).cast("int")
            some = stays.where(within(left, min(wanted), max(wanted) + timedelta(days=1)))
            counted = some.groupBy(*self.keys, day.alias("day"), length.alias("_bucket")).agg(F.count("*").alias("_n"))
            self.store.put(counted, wanted)
        return wanted

    def _windows(self) -> list[tuple[date, date, int, str]]:
        """(first, last, written, run) of the stored sums."""
        found = []
        for name in files.names(self.spark, f"{self.path}/windows"):
            if not name.startswith(("_", ".")):
                first, last, written, run = name.split("_")
                found.append((date.fromisoformat(first), date.fromisoformat(last), int(written), run))
        return found

    def window(self, first: date, last: date) -> DataFrame:
        """The counts of all discharges from ``first`` to ``last`` (not with it)."""
        ledger = self.store.ledger()
        if lacking := [d for d in days_between(first, last) if d not in ledger]:
            raise LookupError(f"{len(lacking)} days are not stored, the first is {lacking[0]}")
        # A sum holds as long as none of its days was stored again after it.
        valid = [
            w for w in self._windows() if all(ledger[d][1] < w[2] for d in days_between(w[0], w[1]) if d in ledger)
        ]
        changed = lambda w: len(set(days_between(first, last)) ^ set(days_between(w[0], w[1])))
        best = min(valid, key=changed, default=None)
        if best and not changed(best):
            return self._sum(best[3])
        if best and changed(best) < (last - first).days:
            old = self._sum(best[3])
            counts = old.unionByName(self._signed(first, last, best[0], best[1])).unionByName(
                self._signed(best[0], best[1], first, last, -1)
            )
        else:
            counts = self.store.get(first, last).drop("day")
        summed = counts.groupBy(*self.keys, "_bucket").agg(F.sum("_n").alias("_n")).where("_n <> 0")
        run = uuid.uuid4().hex
        written = max([w for _, w in ledger.values()], default=0) + 1
        summed.write.parquet(f"{self.path}/sums/{run}")
        files.put_text(self.spark, f"{self.path}/windows/{first}_{last}_{written}_{run}", run)
        return self._sum(run)

    def _sum(self, run: str) -> DataFrame:
        return self.spark.read.schema(self._counts).parquet(f"{self.path}/sums/{run}")

    def _signed(self, first: date, last: date, but_first: date, but_last: date, sign: int = 1) -> DataFrame:
        """Counts of days in one range and not in another."""
        parts = [
            self.store.get(a, b)
            for a, b in ((first, min(last, but_first)), (max(first, but_last), last))
            if a < b
        ]
        rows = self.spark.createDataFrame([], self._counts)
        for part in parts:
            rows = rows.unionByName(part.drop("day"))
        return rows.withColumn("_n", F.col("_n") * sign)

    def curves(self, first: date, last: date, horizon: int) -> DataFrame:
        """Survival curves, as arrays, of all discharges from ``first`` to ``last``."""
        if horizon > self.longest:
            raise ValueError(f"stays are counted up to {self.longest} days")
        length: Column = F.least("_bucket", F.lit(horizon + 1)).alias("_bucket")
        counts = self.window(first, last).groupBy(*self.keys, length).agg(F.sum("_n").alias("_n"))
        return survival.curves_of(counts, self.keys, F.lit(horizon))
