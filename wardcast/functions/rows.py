"""Turning counted rows back into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK = 65536


def repeat_rows(df: DataFrame, copies: str = "copies") -> DataFrame:
    """One output row per counted copy.

    Expands in blocks so that no single generated array grows with the count.
    """
    n = F.col(copies)
    return (
        df.withColumn("_block", F.explode(F.expr(f"sequence(0L, ({copies} - 1) div {_BLOCK})")))
        .withColumn(
            "_copy",
            F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_BLOCK), n - F.col("_block") * _BLOCK))),
        )
        .drop("_block", "_copy", copies)
    )
