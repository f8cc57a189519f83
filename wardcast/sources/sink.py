"""Writing the forecast so that readers see a whole run or the one before it.

A run is a folder of its own. It counts once a marker names it, a small file that is put in
place by one rename after all of the run is written; so a run that fails leaves nothing that a
reader could meet, and running again adds a run and doubles none.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from wardcast.sources import files


def write_forecast(forecast: DataFrame, path: str, as_of: date) -> str:
    """Stores a run for ``as_of`` and makes it the one that readers see; returns its name.

    Parquet, one directory per prediction status, so that a reader who wants only the
    forecast or only the history prunes the rest.
    """
    spark = forecast.sparkSession
    run = uuid.uuid4().hex
    try:
        forecast.write.partitionBy("prediction_status").parquet(f"{path}/runs/{run}")
    except BaseException:
        files.remove(spark, f"{path}/runs/{run}")
        raise
    marker = f"{as_of:%Y-%m-%d}.{time.time_ns():020d}.{run}"
    files.put_text(spark, f"{path}/published/{marker}", forecast.schema.json())
    return run


def _published(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(reporting day, run, marker) of each published run, the latest of a day last."""
    found = []
    for name in files.names(spark, f"{path}/published"):
        if not name.startswith(("_", ".")):
            day, _, run = name.split(".")
            found.append((day, run, name))
    return found


def read_forecast(spark: SparkSession, path: str, as_of: date | None = None) -> DataFrame:
    """The last run published for ``as_of``, or for the latest reporting day there is."""
    found = [x for x in _published(spark, path) if as_of is None or x[0] == f"{as_of:%Y-%m-%d}"]
    if not found:
        raise LookupError(f"no forecast published in {path}" + (f" for {as_of}" if as_of else ""))
    _, run, marker = found[-1]
    schema = StructType.fromJson(json.loads(files.get_text(spark, f"{path}/published/{marker}")))
    return spark.read.schema(schema).parquet(f"{path}/runs/{run}").select(*schema.names)


def tidy(spark: SparkSession, path: str) -> None:
    """Removes runs that a later run of their day has replaced, and what failed runs left.

    Not while a run is being written, which looks like one that failed.
    """
    found = _published(spark, path)
    last = {day: (run, marker) for day, run, marker in found}
    for _, _, marker in found:
        if marker not in {m for _, m in last.values()}:
            files.remove(spark, f"{path}/published/{marker}")
    for run in files.names(spark, f"{path}/runs"):
        if run not in {r for r, _ in last.values()}:
            files.remove(spark, f"{path}/runs/{run}")
