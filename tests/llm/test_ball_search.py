"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from wardcast.llm import ball_search
from wardcast.llm.shared import Scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, top):
    """``docs`` (doc_id, text), ``items`` (item_id, text)."""
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    documents, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 50 + (50 * sum(bag.values()) * documents) // total
            score = 0
            for t in set(TERM.findall((text or "").translate(LOWER))) & set(bag):
                w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


def run(spark, folder, docs, items, top=50):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, terms string, n int").repartition(3)
    b = spark.createDataFrame([(i, t, 2.0) for i, t in items], "item_id bigint, text string, score double")
    return [tuple(r) for r in ball_search.rank(d, b, top, Scratch(spark, str(folder))).collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], -r[3], r[2] is None, r[2] or 0))


def corpus(seed, n, words=60):
    r = random.Random(seed)
    known = ["w%d" % i for i in range(words)] + ["É", "été", "Ab", "aB"]
    return [(i, " ".join(r.choice(known[: r.choice((5, 20, 64))]) + r.choice(("", ".", "_x", "\x00")) for _ in range(r.randint(1, 40)))) for i in range(n)]


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ball_search, "LEAF", 4)
    docs = corpus(1, 300)
    docs += [(900 + i, docs[7][1]) for i in range(20)]  # ties, beyond the last rank
    docs += [(3, docs[3][1]), (3, docs[3][1]), (None, docs[3][1]), (None, None), (1000, None), (1001, ""), (1002, " .,-\n")]
    docs += [(1003, "w1 " * 200_000), (1004, "longest" * 50_000)]
    items = [(i, t) for i, t in corpus(2, 12)] + [(1, "w1 w2"), (1, "w1 w2"), (50, None), (51, ""), (52, "not here at all"), (None, "ab AB été")]
    got = run(spark, tmp_path, docs, items, 10)
    assert order(got) == order(brute(docs, items, 10))


def test_few_documents_and_empty_tables(spark, tmp_path):
    items = [(1, "a b"), (2, "c")]
    assert run(spark, tmp_path, [], items) == []
    assert run(spark, tmp_path, [(1, None), (2, "?")], items) == []
    assert run(spark, tmp_path, [(1, "a")], []) == []
    docs = [(1, "a c"), (2, "A, b"), (3, "d")]
    assert order(run(spark, tmp_path, docs, items)) == order(brute(docs, items, 50))


def test_items_in_several_passes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ball_search, "ITEMS", 3)
    docs, items = corpus(3, 60), corpus(4, 11) + [(0, "w3"), (0, "w3")]
    assert order(run(spark, tmp_path, docs, items, 5)) == order(brute(docs, items, 5))


def test_small_blocks_give_the_same(spark, tmp_path, monkeypatch):
    docs, items = corpus(5, 200), corpus(6, 8)
    known = ball_search.vectors(spark.createDataFrame(docs, "doc_id bigint, text string"), np.unique(np.concatenate(ball_search._terms([t for _, t in items]))))
    rows = known.collect()
    assert {r["doc_id"] for r in rows} == {i for i, t in docs if TERM.search(t)}
    by = {}
    for cells in (1 << 23, 200):
        monkeypatch.setattr(ball_search, "CELLS", cells)
        best = [ball_search.Best(5) for _ in range(2)]
        weights = ball_search.Weights([np.array([0, 2, 5]), np.array([1, 3])], [np.array([900, 50, 7]), np.array([3, 4])], 200, 4000)
        stored = spark.createDataFrame(rows, known.schema).coalesce(1)
        by[cells] = sorted(tuple(r) for r in ball_search.search(stored, weights, 5).collect())
        assert len(best) == 2
    assert by[1 << 23] == by[200] and by[200]


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold_for_all_rows_below(seed):
    r = np.random.default_rng(seed)
    rows = (r.integers(0, 1_000_000, (150, 30)) * (r.random((150, 30)) < 0.2)).astype(np.float32)
    rows[10:40] = rows[9]
    queries = (r.integers(0, 14_000, (30, 6)) * (r.random((30, 6)) < 0.3)).astype(np.float64)
    tree = ball_search.Tree(rows, 8)
    bounds = tree.bounds(queries)
    assert sorted(tree.order) == list(range(150))
    for node, (a, b) in enumerate(zip(tree.first, tree.last, strict=True)):
        exact = rows[tree.order[a:b]].astype(np.int64) @ queries.astype(np.int64)
        assert (exact.max(axis=0) <= bounds[node]).all()
        assert tree.left[node] >= 0 or b - a <= 8


def test_nodes_out_of_reach_are_not_opened(monkeypatch):
    """Two kinds of documents with terms of their own: a search for one never opens the other's leaves."""
    rows = np.zeros((64, 10), np.float32)
    rows[::2, :5], rows[1::2, 5:] = 1000, 1000
    rows[:, 0] += np.arange(64) * (rows[:, 0] > 0)
    tree = ball_search.Tree(rows, 4)
    opened = []

    class Seen(np.ndarray):
        def __getitem__(self, key):
            opened.append(key)
            return np.asarray(self)[key]

    best = ball_search.Best(3)
    weights = np.array([100, 100])
    queries = np.zeros((10, 1))
    queries[[0, 1], 0] = weights
    ordered = rows[tree.order]
    ball_search._best_first(tree, ordered.view(Seen), tree.bounds(queries)[:, 0], np.array([0, 1]), weights, list(range(64)), best)
    assert sorted(best.held, reverse=True) == [(100 * (2000 + i), -i) for i in (62, 60, 58)]
    assert len(opened) < 16
