"""Decontamination when the benchmark's tables are too large to broadcast."""

import random
import re

import pytest

from wardcast.llm import decontamination
from wardcast.llm.shared import Scratch


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture
def tables(spark):
    r = random.Random(1)
    items = [prose(r, r.choice((3, 8, 20, 40))) for _ in range(30)] + [None, "a b c d e f g h"]
    texts = [f"{prose(r, 40)} {r.choice(items[:30])} {prose(r, 40)}" for _ in range(80)] + [None, "", items[3], items[3], "a " * 300]
    docs = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, words string")
    return docs.repartition(3), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")


def found(docs, items, folder):
    got = decontamination.leaks(docs, items, scratch=Scratch(docs.sparkSession, str(folder))).collect()
    return sorted(tuple(r) for r in got)


def test_a_large_benchmark_gives_the_same(spark, tmp_path, tables, monkeypatch):
    small = found(*tables, tmp_path / "small")
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", -1)
    assert found(*tables, tmp_path / "large") == small and len(small) > 50


def test_no_words_are_shuffled_by_hash(spark, tables, monkeypatch):
    docs, items = tables
    body = docs.selectExpr("doc_id", "split(text, ' ') AS words").selectExpr("*", "size(words) AS size", "monotonically_increasing_id() AS row")
    places = spark.createDataFrame([(1, 8, [0])], "hash bigint, n int, at array<int>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = decontamination._met_by_row(body, places, 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.splitlines()
    moved = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(hash" in line]
    sides = []
    for i in moved:
        shuffled = lines[i + 1].partition("Project [")[2]
        while shuffled != (shuffled := re.sub(r"\([^()]*\)", "", shuffled)):
            pass  # arguments of functions are no columns
        sides.append({part.strip().partition("#")[0] for part in shuffled.split(",")})
    assert len(sides) == 2 and any("row" in names for names in sides)
    assert not any({"words", "size", "doc_id"} & names for names in sides)
