"""The operators over the whole test tables, with the columns their results are checked by."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.llm import (
    ball_search,
    chat_windows,
    decontamination,
    hard_negatives,
    jaccard_join,
    license_scan,
    packing,
    page_text,
    pii,
    quality_rules,
    ring_shards,
    secret_scan,
    token_trees,
)
from wardcast.llm.shared import table

SHARDS = 24


def vocabulary(name: str, folder: str | None = None) -> str:
    """Where a public tokenizer's file lies: in the folder, else where its package has it."""
    if folder is None:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    return str(Path(folder) / name)


def split_pattern() -> str:
    """The pattern of pre-tokens that belongs to the byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents")).select("row.doc_id", *MEASURES)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "kept_chars"]


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat_windows.windows(turns, vocabulary("byte_bpe_50k.tiktoken"), split_pattern())
    return chat_windows.read_back(made)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "row.doc_id",
        *[count(k) for k in pii.BASE],
        F.sha2(pii.listed(pii.base_of(F.col("spans"))), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("edits", token_trees.sample_edits(F.col("text"), F.col("source"), F.col("lang")))
    known = vocabulary("byte_bpe_50k.tiktoken"), split_pattern()
    return token_trees.recount(token_trees.build(docs, *known, keep="edits"), *known)


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    placed = ring_shards.assign(rows, ["doc_id", "text_crc32", "size"], SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packing.pack(spark, cut).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.secrets(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in secret_scan.KINDS])
    span = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])
    base = F.transform("base", span)
    added = F.transform("found", lambda s: F.concat_ws(":", F.lit("random"), s["start"], s["end"]))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *[of(i).alias(f"n_{k}") for i, k in enumerate(secret_scan.KINDS)],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, added), ",").alias("spans"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").where(finite).select(
        F.col("vec_id").alias("id"), moved.alias("label"), F.transform(x, lambda v: F.floor(256 * v)).alias("vector")
    )
    return hard_negatives.mine(rows, rows.where("id % 100 = 0"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(table(spark, sf_dir, "pages"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_chat_formatting,
        op3_pii,
        op4_token_counts,
        op5_license_scans,
        op6_sharding,
        op7_decontamination,
        op8_best_fit_packing,
        op9_ngram_jaccard_join,
        op10_secret_scans,
        op11_hard_negatives,
        op12_html_extraction,
        op13_ranked_search,
    )
}
