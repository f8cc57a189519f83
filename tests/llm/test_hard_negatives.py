"""Hard negatives against brute force over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardcast.llm import hard_negatives, queries
from wardcast.llm.shared import Scratch

FORM = "id bigint, label bigint, vector array<bigint>, window string, score double"


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))  # a shorter one is filled up with 0


def first(rows, n):
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:n]


def brute(rows, anchors, positives=5, negatives=5, low=80, high=100):
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    out = []
    for i, label, vector in anchors:
        if label is None or vector is None:
            continue
        others = [(dot(vector, v), j, l) for j, l, v in rows if i is None or j != i]
        for p, q, _ in first([o for o in others if o[2] == label], positives):
            window = [o for o in others if o[2] != label and low * p <= 100 * o[0] <= high * p]
            out += [(i, q, k + 1, n[1], p, n[0]) for k, n in enumerate(first(window, negatives))]
    return out


def key(rows):
    return sorted((tuple((x is None, x or 0) for x in r) for r in rows))


def run(spark, folder, rows, anchors, **more):
    frame = lambda some: spark.createDataFrame([(*r, "x", 0.0) for r in some], FORM)
    got = hard_negatives.mine(frame(rows).repartition(3), frame(anchors), scratch=Scratch(spark, str(folder)), **more)
    assert [f"{n} {t}" for n, t in got.dtypes] == hard_negatives.MINED.split(", ")
    return [tuple(r) for r in got.collect()]


def rows_of(seed, n=400, d=20, labels=4):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 60, (labels, d)) * np.linspace(2, 0.1, d)
    label = r.integers(0, labels, n)
    vectors = np.floor(centres[label] + r.normal(0, 50, (n, d))).astype(int)
    return [(i, int(label[i]), vectors[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, tmp_path, seed, monkeypatch):
    if seed:
        monkeypatch.setattr(hard_negatives, "CELLS", 1000)  # blocks of 50 rows
        monkeypatch.setattr(hard_negatives, "HOPED", (2, 6))  # guesses that often fail
    if seed == 2:
        monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
        monkeypatch.setattr(hard_negatives, "SAMPLE", 40)
    rows = rows_of(seed)
    anchors = rows[::25]
    assert key(run(spark, tmp_path, rows, anchors)) == key(brute(rows, anchors))


def test_odd_rows(spark, tmp_path):
    rows = rows_of(7, 60, 6, 2)
    rows += [rows[3], rows[3], (3, 1, rows[4][2])]  # repeated ids
    rows += [(100 + i, i % 2, rows[5][2]) for i in range(20)]  # equal vectors: ties
    rows += [(None, 0, rows[5][2]), (None, 1, rows[5][2]), (None, None, rows[5][2]), (200, None, rows[5][2]), (201, 0, None)]
    rows += [(300, 0, []), (301, 1, []), (302, 0, [50]), (303, 1, [60, -3]), (304, 0, [0] * 6), (305, 5, [1] * 6), (-7, 0, [10**6] * 6)]
    anchors = [*rows[::7], rows[3], rows[3], rows[-1], (None, 0, rows[5][2]), (0, 0, rows[5][2]), (999, 77, rows[1][2]), (998, 0, [1, 2])]
    assert key(run(spark, tmp_path, rows, anchors)) == key(brute(rows, anchors))
    more = {"positives": 2, "negatives": 3, "low": 10, "high": 150}
    assert key(run(spark, tmp_path, rows, anchors, **more)) == key(brute(rows, anchors, **more))


def test_empty_tables(spark, tmp_path):
    rows = rows_of(1, 10, 3, 2)
    assert run(spark, tmp_path / "a", [], rows) == []
    assert run(spark, tmp_path / "b", rows, []) == []
    assert run(spark, tmp_path / "c", [(1, None, None)], [(1, None, None)]) == []


def test_long_vectors(spark, tmp_path):
    rows = rows_of(2, 40, 3000, 2)
    assert key(run(spark, tmp_path, rows, rows[::10])) == key(brute(rows, rows[::10]))


@pytest.mark.parametrize("seed", range(4))
def test_no_pair_above_its_threshold_is_left_out(seed):
    r = np.random.default_rng(seed)
    shape = np.linspace(3, 0.05, 40)
    rows = np.floor(r.normal(0, 40, (500, 40)) * shape).astype(np.int64)
    anchors = np.floor(r.normal(0, 40, (30, 40)) * shape).astype(np.int64)
    scores = anchors @ rows.T
    least = np.sort(scores, axis=1)[:, -5].copy()
    if seed == 3:
        least[0] = -5
    a, b = hard_negatives.candidates(rows, anchors, least)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    assert found >= set(zip(*(x.tolist() for x in np.nonzero(scores >= least[:, None])), strict=True))
    assert len(found) < 0.5 * scores.size or seed == 3
    # The index leaves out slices whose norms cannot matter, and only where all thresholds allow it.
    depth = hard_negatives.indexed(hard_negatives.norms_after(rows), hard_negatives.norms_after(anchors), least)
    assert (depth < 5).any() if seed < 3 else (depth == 5).all()


def test_query_moves_labels_and_drops_rows_that_are_not_finite(spark, tmp_path):
    r = np.random.default_rng(5)
    bad = [[1.0, None, 2.0], [float("nan")] * 3, [float("inf"), 0.0, 0.0], None]
    rows = [(i, r.normal(0, 1, 3).tolist() if i % 13 else bad[(i // 13) % 4], int(i % 10) if i % 17 else None) for i in range(500)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()
    valid = []
    for row in stored:
        if row.label is None or row.embedding is None or any(x is None or not np.isfinite(x) for x in row.embedding):
            continue
        label = (row.label + 1) % 10 if row.vec_id % 7 == 0 else row.label
        valid.append((row.vec_id, label, [int(np.floor(256 * x)) for x in row.embedding]))
    got = queries.op11_hard_negatives(spark, str(tmp_path))
    assert key(tuple(r) for r in got.collect()) == key(brute(valid, [v for v in valid if v[0] % 100 == 0]))
    assert got.where(F.col("rank") > 5).count() == 0
