"""Documents cleaned, freed of near copies and benchmark passages, masked and packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but
the last return the columns of ``docs``. :func:`run` stores what a stage returns and reads it
again for the next one.

In every stage null texts count as empty. Rows without doc_id cannot be told apart by it:
they are cleaned, masked and packed like others, take part in the search for benchmark
passages, and are never taken for copies. Rows that repeat a doc_id are documents of their own if
their texts differ; of those with equal texts one stays. Empty tables give empty tables. Further columns of
the documents are carried along, whatever their names, up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.llm import decontamination, jaccard_join, packing, pii, quality_rules
from wardcast.llm.queries import vocabulary
from wardcast.llm.shared import Scratch, only, table


def _with_text(row_and_text: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of ``row`` with another text, and its length as ``n_chars`` if there is one."""
    changed = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return row_and_text.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out failing lines; documents that the rules reject go."""
    return _with_text(only(quality_rules.quality(docs), F.col("kept")), docs.columns, "cleaned")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones: the one with the smallest doc_id.

    Rows that repeat an id are told apart by their texts. Those with other texts are documents
    of their own, and go only if they are linked to another; in a group they come after
    all whose id is not repeated, in the order of a hash. Of rows that repeat id and text one stays, the one
    whose columns come first as JSON.
    """
    scratch = Scratch(spark)
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("text_key"), "text"
    )
    named, nameless = rows.where("id is not null"), rows.where("id is null")
    repeated = scratch.save("repeated", named.groupBy("id").count().where("count > 1").select("id"))
    if repeated.limit(1).count():
        own = F.lit(1 << 62).cast("bigint") + F.xxhash64("id", "text_key").bitwiseAND(F.lit((1 << 61) - 1))
        again = (
            named.join(repeated, "id", "left_semi")
            .groupBy("id", "text_key")
            .agg(F.min_by("row", F.to_json("row")).alias("row"), F.any_value("text").alias("text"))
            .withColumn("id", own)
        )
        named = named.join(repeated, "id", "left_anti").unionByName(again)
        named = scratch.save("told-apart", named)
    found = scratch.save("components", jaccard_join.join(named.select("id", "text"), doc_id="id", scratch=scratch))
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("id"))
    return named.join(first, "id", "left_semi").select("row").unionByName(nameless.select("row")).select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("text_key"), "text")
    found = decontamination.leaks(rows, table(spark, sf_dir, "benchmark"), doc_id="text_key")
    keys = Scratch(spark).save("leaks", found.select("doc_id").distinct())
    return rows.join(decontamination.sized(keys), F.col("text_key") == F.col("doc_id"), "left_anti").select("row.*")


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return _with_text(pii.redact(pii.find(docs)), docs.columns, "redacted")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 2048 tokens."""
    return packing.pack(spark, packing.pieces(docs, vocabulary("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("personal data", masked),
    ("best-fit packing", packed),
]

#: Token ids cannot be made in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(name.replace(" ", "-"), stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
