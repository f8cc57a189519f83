"""Documents linked by the Jaccard similarity of their word shingles, by grouped prefixes.

Exact at every size: equal sets become one, sets with the same prefix and size one group, and
a pair of sets is only left unverified if it cannot reach the threshold or if other links
already join the two. Before whole sets are sent, the parity bits of the two must be near
enough: as many bits as differ, so many shingles at least are in one of them only.

1. A sketch counts all shingles; it gives the order in which shingles stand in a prefix,
   rare ones first. Any order is right, this one keeps frequent shingles out of prefixes.
2. Each document's prefix has to share a shingle with every document it can be linked to.
   Wherever prefixes meet in a shingle, all groups are held against the one in which it
   stands earliest, and members of a group against the first member: as many pairs as rows.
3. What is linked by then has a common component. Where prefixes of different components
   still meet, sets of one component and size are again one group; pairs of groups that
   pass the bounds on size and place are expanded to their members and verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardcast.llm import word_hashes
from wardcast.llm.shared import Scratch

#: Percentage of the union that two sets must share.
LIKE = 75
SHINGLE = 5
#: Counters of the sketch, in so many parts when they are added up, and tables of counters that
#: are added in one task. With three such steps the last one gets few, however many tasks counted.
CELLS, PARTS, ADDED = 1 << 23, 64, 256
#: A shingle whose counter is no higher is in so few prefixes that one task may hold them.
LIGHT = 20_000
#: Parity bits of a set: how many of its shingles fall on each bit, odd or even.
BITS = 1024
#: Ids that may be broadcast (16 bytes each); more are joined.
MOST_BROADCAST = 1_000_000

_GROUP_BITS = 43


def _prefix_length(n: int, like: int = LIKE) -> int:
    return n + (like * n) // -100 + 1  # n - ceil(like * n / 100) + 1


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _level(counts: np.ndarray) -> np.ndarray:
    """Eight levels for every doubling of a count; in order, and a byte for any count."""
    return np.minimum(8 * np.log2(counts + 1.0), 255).astype(np.uint8)


#: Counters of one part: a byte each, and for those that do not fit their place and count.
_COUNTS = "part int, bunch int, counts binary, places binary, more binary"


def _counters(part: int, bunch: int, counts: np.ndarray) -> pa.RecordBatch:
    large = np.flatnonzero(counts >= 255)
    row = [
        pa.array([part], pa.int32()),
        pa.array([bunch], pa.int32()),
        pa.array([np.minimum(counts, 255).astype(np.uint8).tobytes()], pa.binary()),
        pa.array([large.astype(np.int32).tobytes()], pa.binary()),
        pa.array([counts[large].astype(np.int64).tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(row, names=["part", "bunch", "counts", "places", "more"])


def _added(batches: Iterator[pa.RecordBatch]) -> tuple[int, int, np.ndarray]:
    """(part, bunch, sums) of tables of counters."""
    total, part, bunch = np.zeros(CELLS // PARTS, np.int64), 0, 0
    for batch in batches:
        part, bunch = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
        for counts, places, more in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
            one = np.frombuffer(counts.as_py(), np.uint8).astype(np.int64)
            one[np.frombuffer(places.as_py(), np.int32)] = np.frombuffer(more.as_py(), np.int64)
            total += one
    return part, bunch, total


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """The level of how often the shingles of each cell occur, counted once for a document.

    The counts are true ones. They are added up in a tree: those of ``ADDED`` tasks, of as many such
    bunches, and those that are left."""

    def count(batches: Iterator):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for a, b, data, starts in word_hashes.slices(batch.column(1)):
                found, begins, _ = word_hashes.shingles(data, starts, k)
                once = [np.unique(found[begins[i] : begins[i + 1]]) for i in range(b - a)]
                np.add.at(total, _cells(np.concatenate(once)), 1)
        for i, part in enumerate(total.reshape(PARTS, -1)):
            if part.any():
                yield _counters(i, 0, part)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _counters(*_added(batches))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums as levels, so that the sketch is a byte for each cell."""
        part, _, total = _added(batches)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_level(total).tobytes()], pa.binary())], names=["part", "counts"])

    parts = docs.mapInArrow(count, _COUNTS).withColumn("bunch", F.spark_partition_id())
    for _ in range(2):
        parts = parts.withColumn("bunch", F.floor(F.col("bunch") / ADDED).cast("int")).groupBy("part", "bunch").applyInArrow(add, _COUNTS)
    out = np.zeros((PARTS, CELLS // PARTS), np.uint8)
    for r in parts.groupBy("part").applyInArrow(finish, "part int, counts binary").collect():  # of one size, however many documents
        out[r["part"]] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: ``light``: so many shingles at the head of the prefix are light.
PREFIXES = (
    "doc_id bigint, text_key bigint, n bigint, set1 bigint, set2 bigint, grp bigint, light bigint, "
    "prefix array<bigint>, bits array<bigint>"
)


def _prefixes(docs: DataFrame, order: Broadcast, k: int, like: int) -> DataFrame:
    """Per document the size of its set, a digest of it, its group, its prefix in order, its bits."""
    most = int(_level(np.array([LIGHT]))[0])

    def run(batches: Iterator):
        counts = order.value
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b, data, starts in word_hashes.slices(batch.column(1)):
                found, begins, _ = word_hashes.shingles(data, starts, k)
                rows = []
                for i in range(b - a):
                    own = np.unique(found[begins[i] : begins[i + 1]])
                    n = len(own)
                    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    set1, set2 = np.frombuffer(digest, np.int64).tolist()
                    if n:
                        count = counts[_cells(own)]
                        p = _prefix_length(n, like)
                        first = np.lexsort((own, count))[:p]
                        prefix, light = _signed(own[first]), int((count[first] <= most).sum())
                    else:
                        prefix, light = np.zeros(0, np.int64), 0
                    group = hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "big"), digest_size=8).digest()
                    grp = int.from_bytes(group, "big") >> (64 - _GROUP_BITS)
                    rows.append((keys[a + i], texts[a + i], n, set1, set2, grp, light, prefix, _parity(own)))
                yield _prefix_batch(rows)

    chosen = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return chosen.mapInArrow(run, PREFIXES)


def _parity(own: np.ndarray) -> np.ndarray:
    odd = np.bincount((own & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _prefix_batch(rows: list):
    plain = list(zip(*[r[:7] for r in rows], strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays(
        [*[pa.array(c, pa.int64()) for c in plain], _lists([r[7] for r in rows]), _lists([r[8] for r in rows])],
        names=["doc_id", "text_key", "n", "set1", "set2", "grp", "light", "prefix", "bits"],
    )


def _enough(nx: Column, px: Column, ny: Column, py: Column, like: int) -> Column:
    """Whether sets of these sizes that share the shingles at these places may still be alike."""
    most = 1 + F.least(nx - px - 1, ny - py - 1)
    return (100 * F.least(nx, ny) >= like * F.greatest(nx, ny)) & ((100 + like) * most >= like * (nx + ny))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(v, root): the smallest id that can be reached from each end of the edges (a, b)."""
    both = scratch.save("edges", edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = scratch.save("labels", both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("seen"))
        step = labels.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "seen").alias("mid"))
        jump = labels.select(F.col("v").alias("mid"), F.col("root").alias("far"))
        new = scratch.save("labels", step.join(jump, "mid", "left").select("v", "old", F.least("mid", "far").alias("root")))
        moved = new.where("old != root").limit(1).count()
        labels = new.select("v", "root")
        if not moved:
            return labels


def _near(pairs: DataFrame, members: DataFrame, like: int) -> DataFrame:
    """The pairs (a, b) that differ in no more parity bits than alike sets can."""
    x = members.select(F.col("cid").alias("a"), F.col("n").alias("xn"), F.col("bits").alias("x"))
    y = members.select(F.col("cid").alias("b"), F.col("n").alias("yn"), F.col("bits").alias("y"))
    differ = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + c)
    # Of the sum of both sizes, alike sets have (100 - like) / (100 + like) in one of them only.
    bound = (100 + like) * differ <= (100 - like) * (F.col("xn") + F.col("yn"))
    return pairs.join(x, "a").join(y, "b").where(bound).select("a", "b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, like: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    x = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(x, "a")
        .join(y, "b")
        .select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sizes"))
        .where((100 + like) * F.col("both") >= like * F.col("sizes"))
        .select("a", "b")
    )


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator):
        for batch in batches:
            for a, b, data, starts in word_hashes.slices(batch.column(1)):
                found, begins, _ = word_hashes.shingles(data, starts, k)
                parts = [_signed(np.unique(found[begins[i] : begins[i + 1]])) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(parts)], names=["cid", "shingles"])

    return docs.mapInArrow(run, "cid bigint, shingles array<bigint>")


def _small(df: DataFrame) -> DataFrame:
    """The ids, marked for broadcasting if they were counted to be few."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def _linked(scratch: Scratch, name: str, pairs: DataFrame, members: DataFrame, docs: DataFrame, repeated: bool, k: int, like: int) -> DataFrame:
    """The pairs that are links. Only texts of pairs that are near enough are read again."""
    near = scratch.save(f"{name}_near", _near(pairs, members, like))
    wanted = _small(scratch.save(f"{name}_ids", near.select(F.col("a").alias("cid")).union(near.select("b")).distinct()))
    texts = docs.join(wanted, F.col("doc_id") == F.col("cid")).select("cid", "text", F.xxhash64("text").alias("text_key"))
    # One id may stand for several texts: only the one that is its set.
    texts = texts.dropDuplicates(["cid", "text_key"]) if repeated else texts
    shingles = scratch.save(f"{name}_sets", _sets(texts.select("cid", "text"), k))
    return scratch.save(f"{name}_links", _verified(near, shingles, like))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, like: int = LIKE, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) for each row of ``docs``.

    ``component_id`` is the smallest doc_id that can be reached over links; two documents are
    linked if they share at least ``like`` percent of the union of their shingles.
    ``text_key`` is ``xxhash64`` of the text, to tell rows with one id apart.

    Letters A to Z count in lower case. A text of fewer than ``k`` words is one shingle; a
    null text or one without words has none and is linked to nothing, its own component. A
    row without doc_id has no component. Repeated rows give a row each. Further columns are
    not read. Equal texts, however many, are one set. Shingles are told apart by 64-bit
    hashes and sets by 128-bit ones.
    """
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    order = spark.sparkContext.broadcast(_sketch(docs.where("doc_id is not null"), k))  # CELLS bytes
    rows = scratch.save("prefixes", _prefixes(docs, order, k, like))
    order.destroy()  # the prefixes are written

    sets = rows.where("n > 0 and doc_id is not null")
    members = scratch.save("members", sets.groupBy("grp", "n", "set1", "set2").agg(F.min("doc_id").alias("cid"), F.first("bits").alias("bits")))

    # Where the groups meet: in each shingle of the prefixes, all of them and the earliest.
    at = sets.select("grp", "n", "light", F.posexplode("prefix").alias("place", "token")).select(
        "token",
        "n",
        (F.col("place") < F.col("light")).alias("light"),
        F.shiftleft(F.least("place", F.lit((1 << 20) - 1)).cast("bigint"), _GROUP_BITS).bitwiseOR(F.col("grp")).alias("spot"),
    )
    group_of = lambda spot: F.col(spot).bitwiseAND(F.lit((1 << _GROUP_BITS) - 1))
    place_of = lambda spot: F.shiftright(F.col(spot), _GROUP_BITS)
    here = Window.partitionBy("token")
    light = at.where("light").select(
        "token", "n", "spot", F.min("spot").over(here).alias("lead"), F.min(group_of("spot")).over(here).alias("low"), F.max(group_of("spot")).over(here).alias("high")
    ).where("low != high").select("token", "n", "spot", "lead")
    heavy = at.where("not light")
    leads = heavy.groupBy("token").agg(F.min("spot").alias("lead"), F.min(group_of("spot")).alias("low"), F.max(group_of("spot")).alias("high"))
    heavy = heavy.join(leads.where("low != high").select("token", "lead"), "token").select("token", "n", "spot", "lead")
    # Nobody stands earlier than the lead; a set that stands too late to be alike with any set
    # at the lead's place, of whatever size, has no link by this shingle.
    in_time = 100 * place_of("spot") + like * place_of("lead") <= (100 - like) * F.col("n")
    meet = light.union(heavy).where(in_time).select(
        "token", group_of("spot").alias("grp"), place_of("spot").alias("place"), group_of("lead").alias("lead"), place_of("lead").alias("lead_place")
    )
    meet = scratch.save("meet", meet)

    heads = members.groupBy("grp").agg(F.min("cid").alias("head"), F.min("n").alias("low_n"), F.max("n").alias("high_n"), F.count("*").alias("many"))
    heads = scratch.save("heads", heads)
    own = heads.select("grp", F.col("head").alias("b"), F.col("low_n").alias("n"))
    to = heads.select(F.col("grp").alias("lead"), F.col("head").alias("a"), F.col("low_n").alias("lead_n"))
    # A group number that two sizes share by chance gets no bound; its pairs are verified.
    mixed = heads.where("low_n != high_n").select("grp").limit(1).count() > 0
    spread = meet.where("grp != lead").join(own, "grp").join(to, "lead")
    if not mixed:
        spread = spread.where(_enough(F.col("n"), F.col("place"), F.col("lead_n"), F.col("lead_place"), like))
    stars = spread.select("a", "b")
    inner = members.drop("bits").join(heads.where("many > 1").select("grp", F.col("head").alias("a")), "grp").select("a", F.col("cid").alias("b"))
    ordered = lambda df: df.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = scratch.save("stars", ordered(stars.union(inner)))

    repeated = _repeated(rows)
    links = _linked(scratch, "star", pairs, members, docs, repeated, k, like)
    roots = components(scratch, links)

    # What is left: groups of one component and size that meet others in a shingle.
    known = members.drop("bits").join(roots.select(F.col("v").alias("cid"), "root"), "cid", "left").select(
        "grp", "n", "cid", F.coalesce("root", "cid").alias("root")
    )
    known = scratch.save("known", known)
    torn = known.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("grp")
    more = sets.join(torn, "grp", "left_semi").select("grp", F.posexplode("prefix").alias("place", "token"))
    spots = meet.select("token", "grp", "place").union(more.select("token", "grp", F.col("place").cast("bigint"))).distinct()
    spots = spots.join(known, "grp").select("token", "place", "n", "cid", "root")
    open_ = spots.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("token")
    spots = scratch.save("spots", spots.join(open_, "token"))
    blocks = scratch.save("blocks", spots.groupBy("token", "root", "n").agg(F.min("place").alias("place")))
    x, y = blocks.alias("x"), blocks.alias("y")
    meets = x.join(
        y,
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.root") < F.col("y.root"))
        & _enough(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place"), like),
    ).select("x.token", F.col("x.root").alias("xr"), F.col("x.n").alias("xn"), F.col("y.root").alias("yr"), F.col("y.n").alias("yn"))
    left = spots.select("token", F.col("root").alias("xr"), F.col("n").alias("xn"), F.col("place").alias("xp"), F.col("cid").alias("a"))
    right = spots.select(F.col("token").alias("t"), F.col("root").alias("r"), F.col("n").alias("m"), F.col("place").alias("yp"), F.col("cid").alias("b"))
    expanded = meets.join(left, ["token", "xr", "xn"]).join(
        right,
        (F.col("token") == F.col("t"))
        & (F.col("yr") == F.col("r"))
        & (F.col("yn") == F.col("m"))
        & _enough(F.col("xn"), F.col("xp"), F.col("yn"), F.col("yp"), like),
    )
    rest = scratch.save("rest", ordered(expanded.select("a", "b")).join(pairs, ["a", "b"], "left_anti"))
    found = _linked(scratch, "rest", rest, members, docs, repeated, k, like)
    if found.limit(1).count():
        roots = components(scratch, links.union(found))

    of_set = members.join(roots.select(F.col("v").alias("cid"), "root"), "cid", "left").select(
        "set1", "set2", F.col("n").alias("m"), F.coalesce("root", "cid").alias("root")
    )
    of_set = of_set.groupBy("set1", "set2", "m").agg(F.min("root").alias("root"))
    named = rows.where("n > 0 and doc_id is not null").join(of_set, (rows.set1 == of_set.set1) & (rows.set2 == of_set.set2) & (F.col("n") == F.col("m")))
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", "text_key", "n", F.col("doc_id").alias("root"))
    return named.select("doc_id", "text_key", "n", "root").union(alone).select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("root").alias("component_id")
    )


def _repeated(rows: DataFrame) -> bool:
    """Whether an id stands for several rows."""
    return rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
