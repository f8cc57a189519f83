"""Licence notices in documents.

MinHash bands over overlapping windows of a text retrieve templates; exact containment of
their shingles verifies them.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcast.llm import word_hashes
from wardcast.llm.license_texts import TEMPLATES


@dataclass(frozen=True)
class Bands:
    """``contained``: percentage of a template's shingles that must stand in a window;
    ``missed``: chance at most that no band of such a window collides."""

    shingle: int = 5
    contained: int = 75
    missed: float = 1e-6
    seed: int = 7

    def number(self) -> int:
        """Bands of one hash each. A window has twice the template's shingles, so with a
        share c of them inside, the sets are alike by at least c / 3."""
        like = self.contained / 100 / (3 - self.contained / 100)
        return math.ceil(math.log(self.missed) / math.log(1 - like))


FOUND = "doc_id bigint, license string, template string, first_word bigint, words bigint, containment double"


class _Template:
    def __init__(self, license_: str, name: str, text: str, k: int):
        data = np.frombuffer(text.encode(), np.uint8)
        hashes, row = word_hashes.words(data, np.array([0, len(data)]), word_hashes.MARKS)
        found, _ = word_hashes.runs(hashes, row, k)
        self.license, self.name = license_, name
        self.set, self.times = np.unique(found, return_counts=True)
        if not len(self.set):
            raise ValueError(f"template {license_}/{name} has fewer than {k} words")


def scan(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, bands: Bands = Bands(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, template, first_word, words, containment) for each notice found.

    Words are runs of letters and digits, without case for A to Z, counted from 0. A template
    of T different shingles is looked for in windows of 2T shingles that begin every T, so
    each stretch of its own length lies whole in one. Of windows that overlap the one with
    most of the template counts, the first of equals. Null texts, empty ones and those of
    fewer than five words hold nothing; a null doc_id is kept; equal rows give equal results;
    further columns are not read. The templates are code or a small table of the caller's,
    sent to the tasks; texts stay where they are.
    """
    known = [_Template(*t, bands.shingle) for t in templates]
    rng = np.random.default_rng(bands.seed)
    factors = rng.integers(0, 1 << 63, bands.number(), np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = []
            for a, _, data, starts in word_hashes.slices(batch.column(1), 1 << 20):
                for where, *rest in _find(data, starts, known, factors, bands):
                    rows.append((keys[a + where], *rest))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, _types(pa), strict=True)],
                names=["doc_id", "license", "template", "first_word", "words", "containment"],
            )

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, FOUND)


def _types(pa):
    return [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()]


def permuted(hashes: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = hashes * factor
    return x ^ (x >> np.uint64(32))


def _find(data: np.ndarray, starts: np.ndarray, known: list[_Template], factors: np.ndarray, bands: Bands):
    hashes, row = word_hashes.words(data, starts, word_hashes.MARKS)
    found, where = word_hashes.runs(hashes, row, bands.shingle)
    if not len(found):
        return
    new_row = np.concatenate([[True], where[1:] != where[:-1]])
    row_start = np.flatnonzero(new_row)
    place = np.arange(len(found)) - np.repeat(row_start, np.diff(np.append(row_start, len(found))))
    sizes = sorted({len(t.set) for t in known})
    cuts = {size: np.flatnonzero(place % size == 0) for size in sizes}
    hits: dict[int, set[int]] = {i: set() for i in range(len(known))}
    for factor in factors:
        turned = permuted(found, factor)
        for size in sizes:
            least = np.minimum.reduceat(turned, cuts[size])
            same = where[cuts[size][1:]] == where[cuts[size][:-1]]
            least[:-1] = np.where(same, np.minimum(least[:-1], least[1:]), least[:-1])
            for i, t in enumerate(known):
                if len(t.set) == size:
                    hits[i].update(np.flatnonzero(least == permuted(t.set, factor).min()).tolist())
    notices: dict[int, list[tuple]] = {}
    for i, t in enumerate(known):
        for x in _verify(t, sorted(hits[i]), cuts[len(t.set)], found, where, place, bands):
            notices.setdefault(x[0], []).append(x)
    for row in sorted(notices):
        yield from _settled(notices[row])


def occurrences(spots: np.ndarray, hashes: np.ndarray, template: _Template, contained: int) -> list[tuple[int, int, float]]:
    """(first shingle, last shingle, containment) of each notice among the places where a
    template's shingles stand.

    A stretch belongs to one notice as long as it has no shingle more often than the template
    has, and at most twice its length. From left to right, the first stretch with enough
    of the template is found; of those that begin inside of it the one with most of it stands,
    then the shortest, then the first, unless what is before that is enough by itself.
    """
    kind = np.searchsorted(template.set, hashes)
    n, size = len(spots), len(template.set)
    least = -(-contained * size // 100)
    held = np.zeros(size, np.int64)
    ends, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
    b = different = 0
    for a in range(n):
        while b < n and spots[b] - spots[a] < 2 * size and held[kind[b]] < template.times[kind[b]]:
            different += held[kind[b]] == 0
            held[kind[b]] += 1
            b += 1
        ends[a], counts[a] = b, different
        held[kind[a]] -= 1
        different -= held[kind[a]] == 0
    out = []
    a = 0
    while a < n:
        if counts[a] < least:
            a += 1
            continue
        # The last shingle that adds to the count ends the notice.
        inside = range(a, int(ends[a]))
        best = min(inside, key=lambda x: (-counts[x], spots[ends[x] - 1] - spots[x], x))
        before = len(np.unique(kind[a:best]))
        first, stop, count = (a, best, before) if before >= least else (best, int(ends[best]), int(counts[best]))
        out.append((int(spots[first]), int(spots[stop - 1]), count / size))
        a = stop
    return out


def _verify(t: _Template, windows: list[int], cuts: np.ndarray, found: np.ndarray, where: np.ndarray, place: np.ndarray, bands: Bands):
    """(row, licence, template, first word, words, containment) of the notices in the windows
    that a band retrieved, and as far around them as a notice may reach."""
    reach = 2 * len(t.set)
    stretches: list[list[int]] = []
    for w in windows:
        row = where[cuts[w]]
        a = max(int(cuts[w]) - reach, int(np.searchsorted(where, row)))
        b = min(int(cuts[w]) + 2 * reach, int(np.searchsorted(where, row, "right")))
        if stretches and where[stretches[-1][0]] == row and a <= stretches[-1][1]:
            stretches[-1][1] = b
        else:
            stretches.append([a, b])
    for a, b in stretches:
        spots = a + np.flatnonzero(np.isin(found[a:b], t.set))
        for first, last, share in occurrences(spots, found[spots], t, bands.contained):
            yield int(where[first]), t.license, t.name, int(place[first]), int(last - first + bands.shingle), float(share)


def _settled(notices: list[tuple]) -> list[tuple]:
    """Without notices that overlap a better one of another licence."""
    order = {x: i for i, x in enumerate(notices)}
    longest = max(x[4] for x in notices)
    kept: list[tuple[int, int, tuple]] = []  # by first word
    for x in sorted(notices, key=lambda x: (-x[5], -x[4], order[x])):
        near = kept[bisect.bisect_left(kept, (x[3] - longest,)) : bisect.bisect_left(kept, (x[3] + x[4],))]
        if not any(k[1] != x[1] and x[3] < k[3] + k[4] for _, _, k in near):
            bisect.insort(kept, (x[3], order[x], x))
    return sorted((x for _, _, x in kept), key=order.__getitem__)
