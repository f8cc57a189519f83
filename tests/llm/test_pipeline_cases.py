"""The pipeline on repeated ids, ties, empty tables, clashing columns and very long texts."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

FORM = "doc_id bigint, text string, row string, words int, id string, near string"


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 7))) for _ in range(n)) + "."


def frame(spark, rows):
    return spark.createDataFrame([(i, t, f"r{n}", n, "x", None) for n, (i, t) in enumerate(rows)], FORM).repartition(3)


def near(spark, rows):
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    assert got.columns == [c.split()[0] for c in FORM.split(", ")]
    return sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)


A, B, C, D = (prose(i) for i in range(4))
NEAR_A = A.replace(A.split()[30], "other")


def test_texts_that_repeat_an_id_stay(spark):
    assert near(spark, [(1, A), (1, B), (2, C)]) == sorted([(1, A), (1, B), (2, C)])


def test_rows_that_repeat_an_id_and_are_linked(spark):
    # One of A and its near copy stays, whatever their ids; B under an id of its own outlives the one under a repeated id.
    assert near(spark, [(1, A), (1, B), (2, NEAR_A), (3, B)]) == sorted([(2, NEAR_A), (3, B)])
    left = near(spark, [(1, A), (1, NEAR_A), (1, C)])
    assert len(left) == 2 and (1, C) in left and left == near(spark, [(1, C), (1, NEAR_A), (1, A)])


def test_rows_that_repeat_id_and_text(spark):
    got = corpus_pipeline.near_duplicates(spark, frame(spark, [(5, A), (5, A), (5, A), (6, C)]), "").collect()
    assert sorted((r["doc_id"], r["row"]) for r in got) == [(5, "r0"), (6, "r3")]


def test_rows_without_id_or_text(spark):
    rows = [(None, A), (None, A), (1, A), (2, None), (2, None), (3, ""), (4, None)]
    assert near(spark, rows) == sorted([(None, A), (None, A), (1, A), (2, None), (3, ""), (4, None)], key=repr)


def test_smallest_id_of_a_group_stays(spark):
    r = random.Random(1)
    ids = r.sample(range(10**6), 40)
    assert near(spark, [(i, A) for i in ids] + [(-3, B)]) == sorted([(min(ids), A), (-3, B)])


def through(spark, folder, docs, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_empty_tables(spark, tmp_path):
    got = through(spark, tmp_path, spark.createDataFrame([], FORM), [])
    assert got.collect() == [] and "sequence_id" in got.columns


def test_all_stages_on_odd_rows(spark, tmp_path):
    long = " ".join(prose(100 + i) for i in range(500))
    rows = [(1, A), (1, B), (1, A), (2, NEAR_A), (None, D), (3, None), (4, ""), (5, long), (6, prose(7, 20)[:-1] + " " + C)]
    got = through(spark, tmp_path, frame(spark, rows), [(1, C), (None, None)])
    pieces = [(r["doc_id"], r["piece"], r["length"]) for r in got.collect()]
    whole = {}
    for i, piece, length in pieces:
        whole.setdefault(i, []).append(piece)
    # 6 holds an item, 3 and 4 have too few words; one of A and its near copy stays.
    assert set(whole) == {1, 2, None, 5} and sorted(whole[1]) == [0]
    assert len(whole[5]) > 5 and sorted(whole[5]) == list(range(len(whole[5])))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_all_columns(spark, tmp_path, stage):
    spark.createDataFrame([(1, B)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = stage(spark, frame(spark, [(1, A), (2, C)]), str(tmp_path))
    assert got.columns == [c.split()[0] for c in FORM.split(", ")]
    assert sorted(got.select("doc_id", "row").collect()) == [(1, "r0"), (2, "r1")]
    assert got.where(F.col("id") != "x").count() == 0
