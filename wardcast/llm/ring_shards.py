"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Rows, keys and ranks are handled by DataFrame operations. Only the number of keys between
two points of the ring reaches the driver, so what it plans with has the size of the ring.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardcast.llm.shared import Scratch

#: Places on the ring.
RING = 1 << 32
#: Equal parts of the ring by which rows are ranked; more parts, more tasks.
PARTS = 4096


def points(shards: int, virtual: int) -> list[tuple[int, int]]:
    """The virtual nodes: (place, shard) by place. A shard's own never depend on the others."""

    def place(shard: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") % RING

    return sorted((place(s, v), s) for s in range(shards) for v in range(virtual))


def fill(arcs: Sequence[tuple[int, int]], counts: dict[int, int], limits: Sequence[int]) -> list[tuple[int, int, int, int, int]]:
    """Which keys of each arc go to which shard: (arc, from, to, shard, slot of ``from``).

    ``arcs`` are the virtual nodes in clockwise order and ``counts`` the keys that have each
    as their next node. Keys of an arc are numbered by their place; those that find their
    shard full go on to the next node whose shard has room. Nodes take their own keys before
    those that overflow into them.
    """
    room, slot = list(limits), [0] * len(limits)
    out, waiting = [], []
    for arc, (_, shard) in enumerate(arcs):
        n = counts.get(arc, 0)
        take = min(n, room[shard])
        if take:
            out.append((arc, 0, take, shard, slot[shard]))
            room[shard] -= take
            slot[shard] += take
        if take < n:
            waiting.append((arc, take, n))
    for arc, at, n in waiting:
        step = arc
        while at < n:
            step += 1
            shard = arcs[step % len(arcs)][1]
            take = min(n - at, room[shard])
            if take:
                out.append((arc, at, at + take, shard, slot[shard]))
                room[shard] -= take
                slot[shard] += take
                at += take
    return out


def limits_of(total: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard may take: with no slack exactly all rows, at most one apart."""
    if slack:
        return [int(total * (1 + slack) / shards) + 1] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def assign(rows: DataFrame, keys: Sequence[str], shards: int, virtual: int = 64, slack: float = 0.0, scratch: Scratch | None = None) -> DataFrame:
    """``keys`` of each row with ``shard`` and ``slot``, its place in the shard from 0.

    A row's place on the ring is the hash of the first key; rows that share it are ordered
    by the other keys. Equal rows are counted, ranked together and dealt out again, so one
    key may hold any share of the rows. A null key has a place like any other. Without slack
    the shards' row counts differ by one at most; with slack ``s`` a shard holds up to 1 + s
    times the mean, and fewer rows move when shards are added. An empty table gives an empty
    result.
    """
    spark: SparkSession = rows.sparkSession
    arcs = points(shards, virtual)
    place = F.pmod(F.xxhash64(F.coalesce(F.col(keys[0]).cast("string"), F.lit("null"))), F.lit(RING))
    known = rows.groupBy(*keys).agg(F.count("*").alias("_copies")).withColumn("_place", place)
    known = known.withColumn("_part", F.floor(F.col("_place") / (RING // PARTS)).cast("int"))
    ends = [p for p, _ in arcs]
    # The arc of a place: of all arcs that end in its part of the ring, the first not before it.
    first = [bisect_right(ends, part * (RING // PARTS) - 1) for part in range(PARTS + 1)]
    table = spark.createDataFrame(
        [(part, [ends[i] for i in range(first[part], first[part + 1])], first[part]) for part in range(PARTS)],
        "_part int, _ends array<bigint>, _first int",
    )
    arc = (F.col("_first") + F.size(F.filter("_ends", lambda e: e < F.col("_place")))) % len(arcs)
    known = known.join(F.broadcast(table), "_part").withColumn("_arc", arc).drop("_ends", "_first")  # PARTS rows

    known = (scratch or Scratch(spark)).save("keys", known)

    # Ranks in an arc: rows before it in its part, and the rows of the parts before.
    per_part = known.groupBy("_arc", "_part").agg(F.sum("_copies").alias("_n"))
    wrapped = (F.col("_arc") == 0) & (F.col("_part") >= PARTS // 2)  # the arc over the ring's start
    turn = F.when(wrapped, F.col("_part") - PARTS).otherwise(F.col("_part"))
    by_arc = Window.partitionBy("_arc").orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.withColumn("_before", F.coalesce(F.sum("_n").over(by_arc), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_arc", "_part").orderBy("_place", *keys).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        known.withColumn("_in", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
        .join(F.broadcast(starts), ["_arc", "_part"])  # at most PARTS + arcs rows
        .withColumn("_rank", F.col("_before") + F.col("_in"))
    )

    counts = {r["_arc"]: r["_n"] for r in per_part.groupBy("_arc").agg(F.sum("_n").alias("_n")).collect()}
    plan = fill(arcs, counts, limits_of(sum(counts.values()), shards, slack))
    planned = spark.createDataFrame(plan, "_arc int, _from bigint, _to bigint, shard int, _slot bigint")
    dealt = ranked.join(F.broadcast(planned), "_arc").where(  # a few rows for each arc
        (F.col("_rank") < F.col("_to")) & (F.col("_rank") + F.col("_copies") > F.col("_from"))
    )
    low = F.greatest("_rank", "_from")
    high = F.least(F.col("_rank") + F.col("_copies"), F.col("_to"))
    return dealt.select(
        *keys, "shard", (F.col("_slot") + low - F.col("_from")).alias("_low"), (high - low).alias("_many")
    ).select(*keys, "shard", F.explode(F.expr("sequence(_low, _low + _many - 1)")).alias("slot"))
