"""Licence notices against a search of every stretch of every text."""

import random
import re
from collections import Counter

import pytest

from wardcast.llm import license_scan
from wardcast.llm.license_scan import TEMPLATES

WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return [w.translate(LOWER) for w in WORD.findall(text)]


def shingles(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


KNOWN = [(name, kind, Counter(shingles(words_of(text)))) for name, kind, text in TEMPLATES]


def stretches(spots, times, first):
    """From the spot numbered ``first``: the longest stretch that is no more than one notice."""
    seen, last = Counter(), first
    for at, shingle in spots[first:]:
        seen[shingle] += 1
        if seen[shingle] > times[shingle] or at - spots[first][0] >= 2 * len(times):
            break
        last += 1
    return last, len({s for _, s in spots[first:last]})


def brute(text):
    """[(license, template, first word, words, containment)] of one text."""
    found = []
    for order, (name, kind, times) in enumerate(KNOWN):
        spots = [(i, s) for i, s in enumerate(shingles(words_of(text))) if s in times]
        size, a = len(times), 0
        while a < len(spots):
            last, count = stretches(spots, times, a)
            if 100 * count < 75 * size:
                a += 1
                continue
            inside = [(x, *stretches(spots, times, x)) for x in range(a, last)]
            best, last, count = min(inside, key=lambda x: (-x[2], spots[x[1] - 1][0] - spots[x[0]][0], x[0]))
            before = len({s for _, s in spots[a:best]})
            if 100 * before >= 75 * size:
                best, last, count = a, best, before
            found.append((name, kind, spots[best][0], spots[last - 1][0] - spots[best][0] + 5, count / size, order))
            a = last
    kept = []
    for x in sorted(found, key=lambda x: (-x[4], -x[3], x[5])):
        if all(k[0] == x[0] or k[2] >= x[2] + x[3] or x[2] >= k[2] + k[3] for k in kept):
            kept.append(x)
    return sorted(x[:5] for x in kept)


def run(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    out = {i: [] for i in range(len(texts))}
    for r in license_scan.scan(frame).collect():
        out[r["doc_id"]].append((r["license"], r["template"], r["first_word"], r["words"], r["containment"]))
    return [sorted(out[i]) for i in range(len(texts))]


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_notices_next_to_each_other(spark):
    r = random.Random(1)
    mit = next(t for n, k, t in TEMPLATES if n == "MIT" and k == "grant")
    n = len(words_of(mit))
    texts = [f"{mit} {mit}", f"{mit} {prose(r, 5)} {mit}", f"{prose(r, 60)} {mit} {prose(r, 60)} {mit}", " ".join([mit] * 7)]
    got = [[x for x in rows if x[1] == "grant"] for rows in run(spark, texts)]
    one = lambda at: ("MIT", "grant", at, n, 1.0)
    assert got[0] == [one(0), one(n)]
    assert got[1] == [one(0), one(n + 5)]
    assert got[2] == [one(60), one(n + 120)]
    assert got[3] == [one(i * n) for i in range(7)]


def test_licences_are_told_apart(spark):
    r = random.Random(2)
    texts = [f"{prose(r, 20)} {text} {prose(r, 20)}" for _, _, text in TEMPLATES]
    for (name, kind, _), rows in zip(TEMPLATES, run(spark, texts), strict=True):
        assert {x[0] for x in rows} == {name} and kind in {x[1] for x in rows}


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(r.randint(0, 6)):
            words = r.choice(TEMPLATES)[2].split()
            way = r.random()
            if way < 0.2 and len(words) > 40:
                words[r.randrange(len(words))] = "changed"
            elif way < 0.3:
                words = words[: r.randint(1, len(words))]
            elif way < 0.4:
                words = words[r.randrange(len(words)) :]
            parts += [" ".join(words), prose(r, r.choice((0, 0, 1, 5, 60, 300)))]
        texts.append(" ".join(parts))
    got, want = run(spark, texts), [brute(t) for t in texts]
    assert got == want
    assert sum(map(len, want)) > 100


def test_many_notices_in_one_text(spark):
    text = " ".join(t for _, _, t in TEMPLATES)
    got = run(spark, [" ".join([text] * 300), None, "", "a b c"])
    assert len(got[0]) == 300 * len(run(spark, [text])[0]) and got[1:] == [[], [], []]
