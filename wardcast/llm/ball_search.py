"""Ranked lexical search: the highest inner products of item and document vectors, exactly.

1. One pass over the texts keeps of each document its length and its counts of terms that some
   item has; sums over all documents give the weights.
2. Blocks of documents become sparse vectors, and each block a ball tree: a node knows the
   centre of its documents' vectors, the radius around it, and which terms occur below it. An
   item's inner product with any document below is at most its product with the centre plus
   the radius times the norm of its weights on those terms.
3. For each item the nodes are opened best bound first, until no bound reaches the score at
   the last rank so far. Bounds are rounded up by more than floating point can err; scores at
   the leaves are sums of integers, exact.
4. Each task's best are merged, first within bunches of tasks, then by item.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardcast.llm import word_hashes
from wardcast.llm.shared import Scratch

#: Documents to return for each item.
TOP = 50
#: Documents of a block at most, and cells of its matrix; documents of a leaf at most.
BLOCK, CELLS, LEAF = 2048, 1 << 23, 32
#: Items, and characters of items, searched for in one pass; more are dealt to further passes.
ITEMS, ITEM_CHARS = 4000, 1 << 24
#: Bounds grow by this share: differences of single precision err by 6e-8, sums of doubles less.
SLACK = 1e-6
#: Tasks whose best are merged first.
BUNCH = 64
#: Sums below this are exact in doubles.
EXACT = 1 << 53

VECTORS = "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"
FOUND = "item int, doc_id bigint, score bigint"


def _terms(texts: list[str | None]) -> list[np.ndarray]:
    """The different terms of each text, as hashes in order."""
    out: list[np.ndarray] = []
    for a, b, data, starts in word_hashes.slices(pa.array(texts, pa.string())):
        hashes, row = word_hashes.words(data, starts, word_hashes.MARKS)
        out += [np.unique(hashes[row == i]) for i in range(b - a)]
    return out


def vectors(docs: DataFrame, known: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts) of each document that has a term: how many terms it has, with
    repeats, and how often it has which of the ``known`` hashes (sorted; terms are places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, starts in word_hashes.slices(batch.column(1)):
                hashes, row = word_hashes.words(data, starts, word_hashes.MARKS)
                sizes = np.bincount(row, minlength=b - a)
                place = np.searchsorted(known, hashes)
                hit = place < len(known)
                hit[hit] = known[place[hit]] == hashes[hit]
                pairs, counts = np.unique(row[hit] * len(known) + place[hit], return_counts=True)
                rows = np.flatnonzero(sizes)
                ends = np.searchsorted(pairs, np.append(rows, b - a) * max(len(known), 1)).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                    for values in ((pairs % max(len(known), 1)).astype(np.int32), counts.astype(np.int64))
                ]
                ids = batch.column(0).slice(a, b - a).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes[rows].astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, VECTORS)


@dataclass(frozen=True)
class Weights:
    """Of each item the places of its terms and their weights; the number of documents, and
    of their terms."""

    terms: list[np.ndarray]
    weights: list[np.ndarray]
    documents: int
    total: int

    def values(self, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What a count is worth in a document of n terms (both by entry)."""
        m = 50 + (50 * n * self.documents) // self.total
        return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


def weigh(found: int, documents: int) -> int:
    """The weight of a term that so many of the documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * found + 1)))


class Tree:
    """A ball tree over the rows of a matrix whose columns are terms.

    ``order`` lists the rows so that a node's are those from ``first`` to ``last``; children
    of node i are ``left[i]`` and the one after it, a leaf has none (-1).
    """

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(rows))
        self.first, self.last, self.left = [0], [len(rows)], [-1]
        centres, radii, support = [], [], []
        at = 0
        while at < len(self.first):
            a, b = self.first[at], self.last[at]
            own = rows[self.order[a:b]]
            centre = own.mean(axis=0, dtype=np.float64)
            apart = own - centre.astype(np.float32)
            far = np.sqrt(np.einsum("ij,ij->i", apart, apart, dtype=np.float64))
            # The centre used is the one in single precision, from which the radius is taken.
            centres.append(centre.astype(np.float32))
            radii.append(float(far.max()) if b > a else 0.0)
            support.append(own.any(axis=0))
            if b - a > leaf:
                # Split halfway between the row farthest out and the one farthest from it.
                one = own[int(far.argmax())]
                away = own - one
                other = own[int(np.einsum("ij,ij->i", away, away).argmax())]
                along = own @ (other - one)
                self.order[a:b] = self.order[a:b][np.argsort(along, kind="stable")]
                self.left[at] = len(self.first)
                middle = (a + b) // 2
                self.first += [a, middle]
                self.last += [middle, b]
                self.left += [-1, -1]
            at += 1
        self.centres = np.stack(centres).astype(np.float64)
        self.radii = np.array(radii)
        self.support = np.stack(support).astype(np.float64)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What no row below a node exceeds, by node and query (columns of ``queries``)."""
        norms = np.sqrt(self.support @ (queries * queries))
        return (self.centres @ queries + norms * self.radii[:, None]) * (1 + SLACK) + 1


class Best:
    """The best documents of an item so far: higher scores, then smaller ids, null last."""

    def __init__(self, top: int):
        self.top, self.held = top, []

    def least(self) -> int:
        """No lower score can still come in."""
        return self.held[0][0] if len(self.held) == self.top else 1

    def add(self, score: int, doc_id: int | None) -> None:
        one = (score, -math.inf if doc_id is None else -doc_id)
        if len(self.held) < self.top:
            heapq.heappush(self.held, one)
        elif one > self.held[0]:
            heapq.heapreplace(self.held, one)


def _search_block(ids: list, ends: np.ndarray, terms: np.ndarray, values: np.ndarray, known: Weights, best: list[Best]) -> None:
    """Adds what a block of documents holds to the best of each item."""
    columns, place = np.unique(terms, return_inverse=True)
    rows = np.zeros((len(ids), len(columns)), np.float32)  # values are below a million
    rows[np.repeat(np.arange(len(ids)), np.diff(ends)), place] = values
    asked, own = [], []
    for item, of in enumerate(known.terms):
        at = np.searchsorted(columns, of)
        here = at < len(columns)
        here[here] = columns[at[here]] == of[here]
        if here.any():
            asked.append(item)
            own.append((at[here], known.weights[item][here]))
    if not asked:
        return
    tree = Tree(rows)
    rows = rows[tree.order]
    for begin in range(0, len(asked), 512):
        some = range(begin, min(begin + 512, len(asked)))
        queries = np.zeros((len(columns), len(some)))
        for i, q in enumerate(some):
            queries[own[q][0], i] = own[q][1]
        bounds = tree.bounds(queries)
        for i, q in enumerate(some):
            _best_first(tree, rows, bounds[:, i], *own[q], ids, best[asked[q]])


def _best_first(tree: Tree, rows: np.ndarray, bound: np.ndarray, places: np.ndarray, weights: np.ndarray, ids: list, best: Best) -> None:
    # Sums of products below 2 ** 53 are exact in doubles, else they are made of integers.
    kind = np.float64 if int(weights.sum()) * 1_000_000 < EXACT else np.int64
    weights = weights.astype(kind)
    heap = [(-bound[0], 0)]
    while heap and -heap[0][0] >= best.least():
        _, node = heapq.heappop(heap)
        child = tree.left[node]
        if child >= 0:
            for c in (child, child + 1):
                if bound[c] >= best.least():
                    heapq.heappush(heap, (-bound[c], c))
            continue
        a, b = tree.first[node], tree.last[node]
        scores = (rows[a:b, places].astype(kind) @ weights).astype(np.int64)
        for i in np.flatnonzero(scores >= best.least()).tolist():
            best.add(int(scores[i]), ids[tree.order[a + i]])


def search(stored: DataFrame, known: Weights, top: int = TOP) -> DataFrame:
    """(item, doc_id, score) of the ``top`` documents of each item (a place in ``known``), and
    some more: each task's own best."""
    sent = stored.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        best = [Best(top) for _ in known.terms]
        for batch in batches:
            terms, counts = batch.column(2), batch.column(3)
            ends = np.asarray(terms.offsets).astype(np.int64)
            counts = np.asarray(counts.values)[ends[0] : ends[-1]]
            terms = np.asarray(terms.values)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            values = known.values(np.repeat(np.asarray(batch.column(1)), np.diff(ends)), counts)
            ids = batch.column(0).to_pylist()
            a = 0
            while a < len(ids):
                b = min(a + BLOCK, len(ids))
                while b > a + 1 and (b - a) * len(np.unique(terms[ends[a] : ends[b]])) > CELLS:
                    b = a + (b - a) // 2
                part = slice(ends[a], ends[b])
                _search_block(ids[a:b], ends[a : b + 1] - ends[a], terms[part], values[part], known, best)
                a = b
        rows = [(i, None if x == -math.inf else -x, s) for i, one in enumerate(best) for s, x in one.held]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"]
        )

    return stored.mapInArrow(run, FOUND)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, scratch: Scratch | None = None, item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` the documents that score
    highest, above 0, equal scores by ascending doc_id.

    Terms are runs of letters, digits and characters beyond ASCII in the whole text, without
    case for A to Z. Null and empty texts have none; such documents count nowhere and such
    items find nothing, and without documents nothing is found. A null doc_id stands behind
    others of its score, a null item_id is kept. Rows that repeat a document are ranked each by
    itself, rows that repeat an item are searched each by itself. Further columns are not read.
    Items are sent to the tasks, at most ``ITEMS`` in one pass over the documents.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    asked = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col("text").alias("text"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    passes = max(1, -(-size["n"] // ITEMS), -(-size["chars"] // ITEM_CHARS))
    found = None
    for i in range(passes):
        # Over one pass the texts decide which, so a repeated item is in one.
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i)
        one = _rank_some(docs, part.collect(), top, scratch, spark)
        found = one if found is None else found.unionByName(one)
    return found


def _rank_some(docs: DataFrame, items: list, top: int, scratch: Scratch, spark: SparkSession) -> DataFrame:
    terms = _terms([r["text"] for r in items])
    known = np.unique(np.concatenate([*terms, np.zeros(0, np.uint64)]))
    stored = scratch.save("vectors", vectors(docs, known))
    sums = stored.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    # One number for each term of the items.
    df = dict(stored.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weight = np.array([weigh(df.get(t, 0), sums["documents"]) for t in range(len(known))], np.int64)
    places = [np.searchsorted(known, t) for t in terms]
    weights = Weights(places, [weight[p] for p in places], sums["documents"], max(sums["total"], 1))
    best = search(stored.where(F.size("terms") > 0), weights, top)
    for group in ([F.floor(F.spark_partition_id() / BUNCH)], []):
        by = Window.partitionBy("item", *group).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], "item int, item_id bigint")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
