"""Placing pieces when one length, or one row, holds a third of all."""

from collections import defaultdict

import pytest

from wardcast.llm import packing
from wardcast.llm.shared import Scratch

FORM = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint"


def check(spark, folder, lengths, ids=None):
    rows = [(ids[i] if ids else i, 0, 0, n, i) for i, n in enumerate(lengths)]
    items = spark.createDataFrame(rows, FORM).repartition(5)
    got = packing.pack(spark, items, scratch=Scratch(spark, str(folder))).collect()
    assert sorted((r["length"], r["ids_crc32"]) for r in got) == sorted((n, i) for i, n in enumerate(lengths))
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(by) >= -(-sum(lengths) // packing.CAPACITY)
    return by


@pytest.mark.parametrize("ranked", [1 << 18, 7])
def test_one_length_with_a_third_of_all(spark, tmp_path, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    lengths = [700] * 500 + [2048] * 500 + [1 + (i * 37) % 2047 for i in range(500)]
    by = check(spark, tmp_path, lengths)
    full = [s for s, parts in by.items() if parts == [(0, 2048)] and s < 0]
    assert len(full) == 500
    assert len(by) == len(check(spark, tmp_path, lengths, ids=[7] * 1500))


def test_equal_rows_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 10)
    items = spark.createDataFrame([(1, 0, 0, 300, 5)] * 400 + [(None, None, None, 300, 5)] * 3, FORM).repartition(4)
    scratch = Scratch(spark, str(tmp_path))
    by = defaultdict(int)
    for r in packing.pack(spark, items, scratch=scratch).collect():
        by[r["sequence_id"]] += 1
    assert sum(by.values()) == 403 and len(by) == -(-403 // 6) and max(by.values()) == 6
    stored = next(tmp_path.glob("corpus-*/pieces-*"))
    salts = {r["_spread"] % 41 for r in spark.read.parquet(str(stored)).collect()}
    assert len(salts) > 35


def test_only_full_pieces_or_none(spark, tmp_path):
    assert len(check(spark, tmp_path, [2048] * 9)) == 9
    assert check(spark, tmp_path, []) == {}
