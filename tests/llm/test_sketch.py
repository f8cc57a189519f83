"""The join's sketch: true counts, whatever the tasks, and the way that hot shingles take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardcast.llm import jaccard_join, word_hashes
from wardcast.llm.shared import Scratch


def levels(texts):
    """Of the shingles of each cell, from a plain count."""
    import pyarrow as pa

    total = np.zeros(jaccard_join.CELLS, np.int64)
    for text in texts:
        for _, _, data, starts in word_hashes.slices(pa.array([text], pa.string())):
            found, _, _ = word_hashes.shingles(data, starts, 5)
            np.add.at(total, jaccard_join._cells(np.unique(found)), 1)
    return jaccard_join._level(total)


@pytest.mark.parametrize(("tasks", "added"), [(1, 256), (9, 256), (9, 2)])
def test_counts_are_true_for_any_number_of_tasks(spark, monkeypatch, tasks, added):
    monkeypatch.setattr(jaccard_join, "ADDED", added)
    texts = [f"hot one two three four {i // 2} b c d e" for i in range(900)] + [None, "", "few words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(tasks)
    got = jaccard_join._sketch(docs, 5)
    assert (got == levels(texts)).all()
    # More than a byte holds, in one task as in many.
    assert got.max() == jaccard_join._level(np.array([900]))[0]


def test_a_hot_shingle_in_few_tasks_is_heavy(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIGHT", 300)
    texts = [f"hot one two three four {i}" for i in range(800)] + [f"x{i} y{i} z{i} u{i} v{i} w{i}" for i in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    order = spark.sparkContext.broadcast(jaccard_join._sketch(docs, 5))
    rows = jaccard_join._prefixes(docs, order, 5, 75).collect()
    # Two shingles, both in the prefix: the rare one is light, the one that 800 texts have is not.
    assert {(r["n"], len(r["prefix"]), r["light"]) for r in rows if r["doc_id"] < 800} == {(2, 1, 1)}
    assert {r["light"] for r in rows if r["doc_id"] >= 800} == {1}
    same = [f"hot one two three {i}" for i in range(400)] * 2
    docs = spark.createDataFrame(list(enumerate(["hot one two three four"] * 400 + same)), "doc_id bigint, text string").repartition(2)
    order = spark.sparkContext.broadcast(jaccard_join._sketch(docs, 5))
    heavy = [r for r in jaccard_join._prefixes(docs, order, 5, 75).collect() if r["light"] == 0]
    assert sorted(r["doc_id"] for r in heavy) == list(range(400))
    got = jaccard_join.join(docs, scratch=Scratch(spark, str(tmp_path)))
    assert got.where("doc_id < 400").agg(F.max("component_id")).first()[0] == 0
    assert {r["doc_id"] - 400 - r["component_id"] for r in got.where("doc_id >= 800").collect()} == {0}
