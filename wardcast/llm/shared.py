"""What several text operators need: a shared folder, words as columns, batches in tasks."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, and tab to carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_CLASS = r"[\x20\x09-\x0D]"

_ROOT = str(Path(__file__).resolve().parents[2])
if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and os.getcwd() != _ROOT:
    # Python workers that cannot import this package get its functions by value.
    cloudpickle.register_pickle_by_value(sys.modules[__package__])


class Scratch:
    """Intermediate tables of one run, in a folder that all executors share.

    The folder is ``folder``, else the session's ``spark.checkpoint.dir``; there is no other
    choice, since a folder of one machine would be lost to the others. Each run writes below a
    name of its own. The result of an operator reads these tables, so the caller closes the scratch,
    or leaves its ``with`` block, when the result is stored.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        folder = folder or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("pass a folder that all executors share, or set spark.checkpoint.dir to one")
        self.spark = spark
        self.root = f"{folder.rstrip('/')}/corpus-{uuid.uuid4().hex}"

    def save(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Removes the tables."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.close()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on columns that are costly to make. A plain filter would be
    moved below the projections, where each such column is put in place of its name and made
    again wherever it is used; what a generator puts out cannot be filtered below it."""
    some = df.select(F.explode_outer(F.when(condition, F.array(F.struct("*")))).alias("one"))
    return some.where("one is not null").select("one.*")


def trimmed(text: Column) -> Column:
    """The text without separators at its ends; null counts as empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))


def words_of(core: Column) -> Column:
    """The words of a text that :func:`trimmed` has prepared."""
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, f"{SEPARATOR_CLASS}+"))


def count_of(text: Column, mark: str) -> Column:
    """How often the string ``mark`` occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("long")


def running(values: Column, join: Callable[[Column, Column], Column], start: Column, block: int = 128) -> Column:
    """Of each element, ``join`` over all elements before it; ``start`` for the first.

    Works by blocks, so the cost stays near the length of the array times the block.
    ``values`` must be a plain column, since it is referred to many times.
    """

    def fold(part: Column) -> Column:
        return F.aggregate(part, start, join)

    tops = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")),
        lambda b: fold(F.slice(values, b * block + 1, F.lit(block))),
    )
    before = F.transform(tops, lambda _, b: fold(F.slice(tops, F.lit(1), b)))
    return F.when(F.size(values) <= 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            values,
            lambda _, i: join(
                F.when(F.size(values) <= block, start).otherwise(F.get(before, F.floor(i / block).cast("int"))),
                fold(F.slice(values, (F.floor(i / block) * block + 1).cast("int"), (i % block).cast("int"))),
            ),
        )
    )


def by_chars(rows: Iterator, size: Callable[[object], int], most: int = 1 << 20) -> Iterator[list]:
    """Lists of rows of about ``most`` characters; a longer row stands alone."""
    held: list = []
    chars = 0
    for row in rows:
        n = size(row)
        if held and chars + n > most:
            yield held
            held, chars = [], 0
        held.append(row)
        chars += n
    if held:
        yield held
