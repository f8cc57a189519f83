"""Documents packed into sequences of at most so many tokens.

A worker turns texts into pieces; Spark counts the pieces of each length. The instance that
is solved is this table of counts, never larger than the capacity: sets of lengths that
provably dominate all alternatives are fixed first, the rest is best-fitted, everything in
multiples. The solution says which ranks of each length go where, and a join with the ranked
pieces places them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardcast.llm.shared import Scratch
from wardcast.llm.token_ids import word_ids

CAPACITY = 2048
#: Pieces of one length that are ranked in one task, about; more are dealt to further tasks.
RANKED = 1 << 18

PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Documents as token ids, closed by ``end``, cut only where longer than ``capacity``.

    A null text counts as empty and gives one piece with the closing id. Texts are never
    cut before they are tokenized. Each input row gives its own pieces, equal rows equal
    ones. Further columns are not read. ``with_ids`` adds the ids as little-endian 32 bits.
    """
    closing = struct.pack("<I", end)

    def run(batches: Iterator):
        import pyarrow as pa

        ids_of = word_ids(tokenizer)
        for batch in batches:
            rows = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of.of(body.as_py() or "") + closing
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part), part))
                if len(rows) >= 4096:
                    yield _batch(pa, rows, with_ids)
                    rows = []
            yield _batch(pa, rows, with_ids)

    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def _batch(pa, rows: list, with_ids: bool):
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    n = 6 if with_ids else 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:n], types, strict=False)], names=names[:n])


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for ``counts`` pieces of each length: (how many such bins, [(length, pieces)]).

    Every step handles a length in a multiple, so the work depends on the number of lengths,
    not of pieces. Bins do not exceed the capacity; each piece is in one.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(s > capacity or s < 1 for s in left):
        raise ValueError("a piece is longer than a sequence or empty")
    done: list[tuple[int, list[tuple[int, int]]]] = []
    for size, times, partners in _dominating(left, capacity):
        content = [(size, 1)]
        for p in partners:
            content = [(size, 2)] if p == size else [*content, (p, 1)]
        done.append((times, content))
    return done + _best_fit(left, capacity)


def _dominating(left: dict[int, int], capacity: int) -> Iterator[tuple[int, int, list[int]]]:
    """Martello and Toth's reduction: from the longest length down, (length, times, partners)
    wherever one set dominates all others that hold the length. Takes them out of ``left``."""
    for size in sorted(left, reverse=True):
        while left.get(size):
            room = capacity - size
            others = _others(left, size)
            fitting = [s for s in others if s <= room]
            if not fitting:  # nothing fits beside it
                yield size, _take(left, size, []), []
                continue
            best = fitting[0]
            exact = best == room
            two = _least_pair(left, size, fitting)
            if exact or two is None or two > room:  # it fills the bin, or only one more fits at all
                yield size, _take(left, size, [best]), [best]
                continue
            three = _least_triple(left, size, fitting)
            if (three is None or three > room) and best >= _best_pair(left, size, fitting, room):
                yield size, _take(left, size, [best]), [best]  # at most two more fit, and never as much
                continue
            break


def _others(left: dict[int, int], size: int) -> list[int]:
    """Lengths of the other pieces, longest first; the length itself if there are two."""
    return [s for s in sorted(left, reverse=True) if s != size or left[s] > 1]


def _free(left: dict[int, int], size: int, s: int) -> int:
    return left[s] - (s == size)


def _smallest(left: dict[int, int], size: int, fitting: list[int], k: int) -> int | None:
    total = 0
    for s in reversed(fitting):
        n = min(k, _free(left, size, s))
        total, k = total + n * s, k - n
        if not k:
            return total
    return None


def _least_pair(left, size, fitting):
    return _smallest(left, size, fitting, 2)


def _least_triple(left, size, fitting):
    return _smallest(left, size, fitting, 3)


def _best_pair(left: dict[int, int], size: int, fitting: list[int], room: int) -> int:
    """The largest sum of two further pieces that fits."""
    best, low = 0, len(fitting) - 1
    for high, a in enumerate(fitting):
        while low >= 0 and a + fitting[low] <= room:
            low -= 1
        for b in fitting[low + 1 :][:2]:  # the longest that fits beside a, or the next if there is one a only
            if b != a or _free(left, size, a) > 1:
                best = max(best, a + b)
                break
    return best


def _take(left: dict[int, int], size: int, partners: list[int]) -> int:
    need: dict[int, int] = {size: 1}
    for p in partners:
        need[p] = need.get(p, 0) + 1
    times = min(left[s] // n for s, n in need.items())
    for s, n in need.items():
        left[s] -= n * times
        if not left[s]:
            del left[s]
    return times


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest lengths first: into the fullest bins that have room, else new ones."""
    open_bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # by room left
    for size in sorted(left, reverse=True):
        n = left[size]
        for room in sorted(r for r in open_bins if r >= size):
            per_bin = room // size
            stays = []
            for times, content in open_bins.pop(room):
                full, rest = divmod(n, per_bin)
                whole = min(times, full)
                if whole:
                    _open(open_bins, room - per_bin * size, whole, [*content, (size, per_bin)])
                    n -= whole * per_bin
                if whole < times and full == whole and rest and n:
                    _open(open_bins, room - n * size, 1, [*content, (size, n)])
                    n, whole = 0, whole + 1
                if whole < times:
                    stays.append((times - whole, content))
            for times, content in stays:
                _open(open_bins, room, times, content)
            if not n:
                break
        per_bin = capacity // size
        full, rest = divmod(n, per_bin)
        if full:
            _open(open_bins, capacity - per_bin * size, full, [(size, per_bin)])
        if rest:
            _open(open_bins, capacity - rest * size, 1, [(size, rest)])
    return [bin_ for bins in open_bins.values() for bin_ in bins]


def _open(open_bins: dict, room: int, times: int, content: list) -> None:
    open_bins.setdefault(room, []).append((times, content))


def places(solution: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, per_bin, first sequence, first offset): ranks of a length and where they go."""
    out, used, sequence = [], {}, 0
    for times, content in solution:
        offset = 0
        for size, per_bin in content:
            at = used.get(size, 0)
            out.append((size, at, at + times * per_bin, per_bin, sequence, offset))
            used[size] = at + times * per_bin
            offset += size * per_bin
        sequence += times
    return out


def pack(spark: SparkSession, items: DataFrame, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """``items`` (column ``length``, doc_id and piece to order by) with sequence_id and offset.

    ``items`` is written to the shared folder, since it is counted and then placed. Pieces of
    full length are sequences of their own, with negative numbers, and are neither ranked nor
    moved. Those of each other length are ranked in as many tasks as their count asks for, into which
    they are dealt by a number stored with them, so that equal rows, however many, part as well. Equal
    rows are placed each for itself. An empty table gives an empty result.
    """
    columns = items.columns
    spread = F.hash("doc_id", "piece", F.monotonically_increasing_id())
    items = (scratch or Scratch(spark)).save("pieces", items.withColumn("_spread", spread))
    counts = dict(items.groupBy("length").count().collect())  # capacity rows at most
    full = items.where(F.col("length") == capacity).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    counts.pop(capacity, None)
    if not counts:
        return full
    salts = spark.createDataFrame([(n, -(-c // RANKED)) for n, c in counts.items()], "length int, _salts bigint")
    part = items.where(F.col("length") != capacity).join(F.broadcast(salts), "length")
    part = part.withColumn("_salt", F.pmod(F.col("_spread"), F.col("_salts")).cast("int")).drop("_spread", "_salts")
    cells = part.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    plan = spark.createDataFrame(
        places(solve(counts, capacity)),
        "length int, _from bigint, _to bigint, _per int, _sequence bigint, _offset bigint",
    )
    in_cell = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = part.withColumn("_row", F.row_number().over(in_cell) - 1).join(
        F.broadcast(starts), ["length", "_salt"]  # one row for RANKED pieces, and one for each length
    )
    ranked = ranked.withColumn("_rank", F.col("_start") + F.col("_row"))
    placed = ranked.join(F.broadcast(plan), "length").where(  # grows with the capacity only
        (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    )
    at = F.col("_rank") - F.col("_from")
    return full.unionByName(
        placed.select(
            *columns,
            (F.col("_sequence") + F.floor(at / F.col("_per"))).cast("bigint").alias("sequence_id"),
            (F.col("_offset") + (at % F.col("_per")) * F.col("length")).cast("bigint").alias("offset"),
        )
    )


def sequences(placed: DataFrame) -> DataFrame:
    """The ids of each sequence, from pieces that carry ``ids``; a group holds one sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.unhex(F.lit("")), lambda a, p: F.concat(a, p["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))
