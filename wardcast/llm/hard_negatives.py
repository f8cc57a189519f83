"""Hard negatives by threshold joins over an index that leaves out what cannot matter.

For each anchor its closest rows of the same label are positives, and for each positive the
closest rows of other labels in a window of scores below it are its hard negatives. Scores are
inner products of integer vectors, exact.

1. Dimensions are put in order, those with most of the vectors' squares first. By
   Cauchy-Schwarz what the dimensions from some place on add to a score is at most the
   product of the two vectors' norms over them. Of each row only as many leading dimensions are
   indexed as leave that below every anchor's threshold.
2. Scores are added up over the indexed dimensions, slice by slice. A row goes as soon as no
   anchor can reach its threshold with it any more; pairs that still can after the last slice
   are scored exactly over all dimensions.
3. Thresholds begin where a few rows are expected above them. What has found enough is done;
   the others go on with lower ones, in the end with none but the window's own end. They are
   guessed from a bounded sample of rows, and a guess that is off costs a pass, never a row.
4. Anchors are dealt into blocks of bounded size; each block is sent to the tasks, which pass
   over all rows. Tasks keep their best for each window, and Spark merges those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardcast.llm.shared import Scratch

#: Anchors of a block, about, and numbers in the vectors of a block of rows.
ANCHORS, CELLS = 1024, 1 << 20
#: Rows that thresholds are guessed from, and rows hoped for above the first and second guess.
SAMPLE, HOPED = 4096, (16, 256)
#: Dimensions that are added up at once.
STEP = 8
#: Share of the product of two norms that sums of doubles may be off by, generously.
SLACK = 1e-9

_NONE = np.iinfo(np.int64).min
_FOUND = "window int, id bigint, score bigint"


@dataclass(frozen=True)
class Windows:
    """What is looked for at once: rows with scores from ``least`` to ``most``, the first
    ``keep`` of each window. ``anchor``: the anchor of each window, as a row of ``vectors``."""

    vectors: np.ndarray
    ids: np.ndarray
    nameless: np.ndarray
    labels: np.ndarray
    anchor: np.ndarray
    least: np.ndarray
    most: np.ndarray
    same: bool
    keep: int


def norms_after(vectors: np.ndarray, step: int = STEP) -> np.ndarray:
    """The norm over the dimensions from 0, step, 2 * step and so on; 0 behind the last."""
    squares = np.square(vectors.astype(np.float64))
    starts = np.arange(0, vectors.shape[1], step)
    slices = np.add.reduceat(squares, starts, axis=1) if len(starts) else np.zeros((len(vectors), 0))
    after = np.cumsum(slices[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([after, np.zeros((len(vectors), 1))], axis=1))


def indexed(rows: np.ndarray, anchors: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How many slices of each row are indexed: the others can add less than any threshold.

    ``rows`` and ``anchors`` are norms as of :func:`norms_after`."""
    reach = np.full(anchors.shape[1], np.inf)
    if len(least) and (least > 0).all():
        reach = (anchors / least[:, None]).max(axis=0) * (1 + SLACK)
    with np.errstate(invalid="ignore"):
        covered = np.nan_to_num(rows * reach, nan=0.0) < 1
    covered[:, -1] = True
    return covered.argmax(axis=1)


def candidates(rows: np.ndarray, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of the pairs that may score ``least`` or more, by anchor; all that do are in."""
    row_norms, anchor_norms = norms_after(rows), norms_after(anchors)
    depth = indexed(row_norms, anchor_norms, least)
    left, right = [], []
    queries = anchors.astype(np.float64)
    slack = SLACK * anchor_norms[:, :1]
    for slices in np.unique(depth[depth > 0]):
        own = np.flatnonzero(depth == slices)
        sums = np.zeros((len(anchors), len(own)))
        for i in range(slices):
            at = slice(i * STEP, (i + 1) * STEP)
            sums += queries[:, at] @ rows[own, at].astype(np.float64).T
            able = sums + anchor_norms[:, i + 1, None] * row_norms[own, i + 1] + slack * row_norms[own, 0] + 0.5 >= least[:, None]
            if i + 1 < slices:
                alive = able.any(axis=0)
                if not alive.all():
                    own, sums = own[alive], sums[:, alive]
        a, r = np.nonzero(able)
        left.append(a)
        right.append(own[r])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _matrix(column: pa.ListArray, order: np.ndarray) -> np.ndarray:
    """The vectors with their dimensions in order, short ones filled up with 0."""
    ends = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    out = np.zeros((len(column), len(order)), np.int64)
    if len(values) == out.size:
        out[:] = values.reshape(out.shape)
    else:
        row = np.repeat(np.arange(len(column)), np.diff(ends))
        out[row, np.arange(len(values)) - ends[row]] = values
    return out[:, order]


def _first(window: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray, keep: int) -> np.ndarray:
    """Places of the first ``keep`` of each window: higher scores, then smaller ids, null last."""
    order = np.lexsort((ids, null, -score, window))
    of = window[order]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    rank = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    return order[rank < keep]


def _exact(anchors: np.ndarray, rows: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    size = max(1, CELLS // max(1, anchors.shape[1]))
    for i in range(0, len(a), size):
        out[i : i + size] = np.einsum("ij,ij->i", anchors[a[i : i + size]], rows[r[i : i + size]])
    return out


def find(stored: DataFrame, windows: Windows, order: np.ndarray) -> DataFrame:
    """(window, id, score): of each window the first rows, and some more: each task's own."""
    sent = stored.sparkSession.sparkContext.broadcast((windows, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, order = sent.value
        least = w.least.copy()
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        size = max(1, CELLS // max(1, len(order)))
        by_anchor = np.argsort(w.anchor, kind="stable")
        asked, begins = np.unique(w.anchor[by_anchor], return_index=True)
        begins = np.append(begins, len(by_anchor))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                rows = _matrix(part.column(2), order)
                ids, null = np.asarray(part.column(0).fill_null(0)), np.asarray(part.column(0).is_null())
                labels = np.asarray(part.column(1))
                # The lowest threshold among an anchor's windows holds for the anchor.
                lowest = np.minimum.reduceat(least[by_anchor], begins[:-1])
                a, r = candidates(rows, w.vectors[asked], lowest)
                fits = ((w.labels[asked[a]] == labels[r]) == w.same) & ((w.ids[asked[a]] != ids[r]) | null[r] | w.nameless[asked[a]])
                a, r = a[fits], r[fits]
                score = _exact(w.vectors[asked], rows, a, r)
                # Each pair is held against all windows of its anchor.
                times = begins[a + 1] - begins[a]
                pair = np.repeat(np.arange(len(a)), times)
                place = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
                window = by_anchor[begins[a[pair]] + place]
                inside = (score[pair] >= least[window]) & (score[pair] <= w.most[window])
                window, pair = window[inside], pair[inside]
                held = [np.concatenate(x) for x in zip(held, (window, score[pair], ids[r[pair]], null[r[pair]]), strict=True)]
                best = _first(*held, w.keep)
                held = [x[best] for x in held]
                # A window that has enough takes nothing below its last any more.
                full = np.bincount(held[0], minlength=len(least)) == w.keep
                last = np.full(len(least), np.iinfo(np.int64).max)
                np.minimum.at(last, held[0], held[1])
                least = np.where(full, np.maximum(least, last), least)
        window, score, ids, null = held
        yield pa.RecordBatch.from_arrays(
            [pa.array(window, pa.int32()), pa.array(ids, pa.int64(), mask=null), pa.array(score, pa.int64())], names=["window", "id", "score"]
        )

    by = Window.partitionBy("window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return stored.mapInArrow(run, _FOUND).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= windows.keep)


@dataclass(frozen=True)
class Guess:
    """Scores of an anchor with rows of one kind, taken to be spread like a bell."""

    mean: np.ndarray
    spread: np.ndarray
    number: np.ndarray

    def above(self, rows: int, most: np.ndarray | None = None) -> np.ndarray:
        """The score above which, up to ``most``, so many rows are expected."""
        bell = NormalDist()
        out = np.full(len(self.mean), _NONE, np.int64)
        for i, (mean, spread, number) in enumerate(zip(self.mean, self.spread, self.number, strict=True)):
            if not (spread > 0 and number > 4 * rows):
                continue
            part = 1.0 if most is None else bell.cdf((float(most[i]) - mean) / spread)
            part -= rows / number
            if 0 < part < 1:
                out[i] = int(mean + spread * bell.inv_cdf(part))
        return out


def _guess(anchors: Windows, sample: np.ndarray, labels: np.ndarray, same: bool, rows: int) -> Guess:
    scores = anchors.vectors.astype(np.float64) @ sample.astype(np.float64).T
    of = (anchors.labels[:, None] == labels) == same
    n = of.sum(axis=1)
    mean = np.where(of, scores, 0).sum(axis=1) / np.maximum(n, 1)
    spread = np.sqrt(np.where(of, np.square(scores - mean[:, None]), 0).sum(axis=1) / np.maximum(n, 1))
    return Guess(mean, np.where(n >= 16, spread, 0), n / max(len(labels), 1) * rows)


def mine(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scratch: Scratch | None = None
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` and ``anchors`` have (id, label, vector): bigint, bigint, array of bigint. A
    positive is one of the first ``positives`` other rows of the anchor's label; its
    negatives are the first ``negatives`` rows of other labels with ``low * p <= 100 * n <= high * p``
    for the scores p and n. Higher scores come first, equal ones by id, null ids last; with
    too few rows all of them.

    Rows without label or vector take no part, as row or anchor. Shorter vectors are filled up
    with 0. A row with the anchor's id is no other row; a null id is nobody's. Rows that repeat
    an id count each, and an anchor that is repeated has its result as often. Empty tables give
    none. Further columns are not read. Scores must fit into a bigint.
    """
    spark: SparkSession = rows.sparkSession
    scratch = scratch or Scratch(spark)
    kinds = [F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("vector")]
    valid = "label is not null and vector is not null"
    stored = scratch.save("rows", rows.select(*kinds).where(valid))
    known = anchors.select(*kinds).where(valid).groupBy("id", "label", "vector").agg(F.count("*").alias("copies"))
    known = scratch.save("anchors", known)
    # A number for each dimension.
    squares = stored.unionByName(known.select("id", "label", "vector")).select(F.posexplode("vector").alias("place", "x"))
    squares = squares.groupBy("place").agg(F.sum(F.col("x").cast("double") * F.col("x")).alias("square")).orderBy("place").collect()
    order = np.argsort([-r["square"] for r in squares], kind="stable").astype(np.int64)
    total, blocks = stored.count(), -(-known.count() // ANCHORS)
    taken = stored.limit(SAMPLE).toArrow() if blocks else None
    found = f"{scratch.root}/mined"
    spark.createDataFrame([], MINED).write.parquet(found)
    for i in range(blocks):
        block = known.where(F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks)) == i).collect()
        if block:
            for done in _mine_block(spark, stored, block, order, taken, total, positives, negatives, low, high, scratch):
                done.write.mode("append").parquet(found)
    return spark.read.schema(MINED).parquet(found)


MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _mine_block(spark, stored, block, order, taken, total, positives, negatives, low, high, scratch) -> Iterator[DataFrame]:
    vectors = _matrix(pa.array([r["vector"] for r in block], pa.list_(pa.int64())), order)
    ids = np.array([r["id"] if r["id"] is not None else 0 for r in block], np.int64)
    nameless = np.array([r["id"] is None for r in block])
    labels = np.array([r["label"] for r in block], np.int64)
    every = np.arange(len(block))
    top = np.full(len(block), np.iinfo(np.int64).max)
    asked = Windows(vectors, ids, nameless, labels, every, top, top, True, positives)
    sample, of = _matrix(taken.column("vector").combine_chunks(), order), np.asarray(taken.column("label").combine_chunks())

    # Positives: an anchor has them when as many as wanted lie above its threshold.
    guess, best = _guess(asked, sample, of, True, total), []
    for hoped in (*HOPED, None):
        if not len(asked.anchor):
            break
        least = guess.above(hoped)[asked.anchor] if hoped else np.full(len(asked.anchor), _NONE)
        got = scratch.save("positives", find(stored, replace(asked, least=least), order)).collect()  # some for each anchor of the block
        full = np.bincount([r["window"] for r in got], minlength=len(least)) == positives
        full |= least == _NONE
        best += [(int(asked.anchor[r["window"]]), r["id"], r["score"]) for r in got if full[r["window"]]]
        asked = replace(asked, anchor=asked.anchor[~full], most=asked.most[~full])

    # Windows below them: from the highest score that fits down to the lowest.
    if not best:
        return
    anchor = np.array([a for a, _, _ in best])
    score = [s for _, _, s in best]
    lowest = np.array([-(-low * s // 100) for s in score], np.int64)
    highest = np.array([high * s // 100 for s in score], np.int64)
    names = [(i, block[a]["id"], p, s, block[a]["copies"]) for i, (a, p, s) in enumerate(best)]
    named = spark.createDataFrame(names, "number int, anchor_id bigint, positive_id bigint, positive_score bigint, copies bigint")
    open_ = np.flatnonzero(lowest <= highest)
    guess = _guess(replace(asked, anchor=every), sample, of, False, total)
    guess = Guess(guess.mean[anchor], guess.spread[anchor], guess.number[anchor])
    for hoped in (*HOPED, None):
        if not len(open_):
            return
        least = np.maximum(lowest, guess.above(hoped, highest)) if hoped else lowest
        least = np.minimum(least, highest)[open_]
        asked = Windows(vectors, ids, nameless, labels, anchor[open_], least, highest[open_], False, negatives)
        got = scratch.save("negatives", find(stored, asked, order))
        count = dict(got.groupBy("window").count().collect())  # a number for each window of the block
        full = (least == lowest[open_]) | (np.array([count.get(w, 0) for w in range(len(open_))]) == negatives)
        numbers = [(int(w), int(open_[w])) for w in np.flatnonzero(full)]
        if numbers:
            done = spark.createDataFrame(numbers, "window int, number int").join(named, "number")
            yield (
                got.join(F.broadcast(done), "window")
                .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
                .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            )
        open_ = open_[~full]
