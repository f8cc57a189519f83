"""Reading the source tables under the names the operators use."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.sources.layout import SOURCES

#: What Spark says of files and names that are not there.
_ABSENT = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND")


class SourceTables:
    """The source tables of one run, opened on first use.

    ``opener`` returns the DataFrame of a logical table name with the column
    names of :data:`wardcast.sources.layout.SOURCES`.
    """

    def __init__(self, spark: SparkSession, opener: Callable[[str], DataFrame]):
        self.spark = spark
        self._opener = opener
        self._opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            df = self._opener(name)
            missing = set(SOURCES[name].columns) - set(df.columns)
            if missing:
                raise ValueError(f"source table {name!r} lacks {', '.join(sorted(missing))}")
            self._opened[name] = df.select(*SOURCES[name].columns)
        return self._opened[name]

    def has(self, name: str) -> bool:
        """Whether there is such a table; one that is there but cannot be read still raises."""
        try:
            self[name]
        except KeyError:
            return False
        except AnalysisException as error:
            if error.getCondition() in _ABSENT:
                return False
            raise
        return True

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: Mapping[str, DataFrame]) -> SourceTables:
        """Tables given as DataFrames that already use the logical names."""
        return cls(spark, lambda name: frames[name])

    @classmethod
    def from_catalog(
        cls,
        spark: SparkSession,
        namespace: str,
        overrides: Mapping[str, str] | None = None,
    ) -> SourceTables:
        """Physical tables of a catalog namespace.

        ``overrides`` gives the full name of tables that live elsewhere, since
        source systems tend to spread them over several databases.
        """
        places = dict(overrides or {})

        def open_table(name: str) -> DataFrame:
            place = places.get(name, f"{namespace}.{SOURCES[name].physical}")
            return to_logical(name, spark.table(place))

        return cls(spark, open_table)

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> SourceTables:
        """Physical tables stored as ``root/<PHYSICAL_NAME>.parquet``."""

        def open_table(name: str) -> DataFrame:
            path = f"{root}/{SOURCES[name].physical}.parquet"
            return to_logical(name, spark.read.parquet(path))

        return cls(spark, open_table)


def to_logical(name: str, df: DataFrame) -> DataFrame:
    """Rename physical columns and bring codes to the type they are compared as.

    Only columns whose type differs are cast, so filters on the others still
    reach the scan. Times keep their stored timestamp flavour.
    """
    stored = {f.name.lower(): f.dataType.simpleString() for f in df.schema.fields}
    picked = []
    for column, (physical, data_type) in SOURCES[name].columns.items():
        have = stored.get(physical.lower())
        if have is None:
            raise ValueError(f"source table {name!r} lacks {physical}")
        keep = have == data_type or (data_type == "timestamp" and have in ("timestamp_ntz", "date"))
        source = F.col(physical)
        picked.append((source if keep else source.cast(data_type)).alias(column))
    return df.select(*picked)
