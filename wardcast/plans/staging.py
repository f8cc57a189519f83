"""Where a plan writes down an intermediate result.

A forecast reads its encounter profile many times. Staging it as a table cuts
the lineage, survives the loss of executors, and gives the optimiser the real
size of the data for its later join choices.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """The given folder, else the one the session names in ``spark.checkpoint.dir``.

    There is no other choice: a folder of one machine would be lost to the others.
    """
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("pass a folder that all executors share, or set spark.checkpoint.dir to one")
    return folder.rstrip("/")


class Lazy:
    """Stages nothing: every use of a result is part of one query plan."""

    stores = False

    def __call__(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        return df

    def close(self) -> None:
        pass


class Tables:
    """Stages a result as Parquet in the shared folder and reads it back.

    With ``by`` the result is stored as a table in buckets of that column, as many as a
    shuffle has partitions, so that joins and groups by it move the other side only; it is
    written in the partitions its own last join left, if that was by the column. The rows of a
    bucket are in order of the column, so that its values compress when there are too many for a dictionary.

    Everything is in a folder of the run's own. ``close``, or leaving a ``with`` block,
    removes it; results that read staged tables must be stored by then.
    """

    stores = True

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self._spark = spark
        self._id = uuid.uuid4().hex
        self._bucketed: list[str] = []
        self.root = f"{shared_folder(spark, folder)}/wardcast-{self._id}"

    def __call__(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        if by is None:
            df.write.parquet(path)
            return self._spark.read.schema(df.schema).parquet(path)
        buckets = int(self._spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"wardcast_{self._id}_{name}"
        # One file per bucket: a task holds whole buckets.
        rows = df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by)
        rows.option("path", path).saveAsTable(table)
        self._bucketed.append(table)
        return self._spark.table(table)

    def close(self) -> None:
        while self._bucketed:
            self._spark.sql(f"DROP TABLE IF EXISTS {self._bucketed.pop()}")
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *error) -> None:
        self.close()
