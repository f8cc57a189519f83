"""Benchmark passages in documents, in DataFrame operations only.

Windows as long as a benchmark item are laid over a document from each word on; those with
enough shingles of items of that length, wherever these stand in them, can be alike. Their
SimHash is looked up in a multi-index of Hamming blocks, which finds every item within the
radius, and the exact weighted similarity decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.llm.shared import Scratch, trimmed, words_of

SHINGLE = 5
#: Two texts are alike from this percentage on: the sum of the smaller counts of each
#: shingle, of the sum of the larger ones.
LIKE = 75
BITS, BLOCKS = 64, 8
#: At the threshold the angle of two sets of numbered shingles is arccos(6/7) at most: 11 of 64
#: bits differ on average, with a deviation of 3. Beyond 24 bits is more than four deviations.
RADIUS = 24
#: Rows of an index table that may be broadcast (five numbers each); more are joined.
MOST_BROADCAST = 500_000


def _words(text: Column) -> Column:
    return words_of(trimmed(F.lower(F.coalesce(text, F.lit("")))))


def _shingles(words: Column, n: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words; of a shorter text one, of all its words."""
    many = F.transform(
        F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]),
    )
    return F.when(n > 0, many).otherwise(F.array().cast("array<bigint>"))


def counted(hashes: Column) -> Column:
    """Tells repeated hashes apart by their number, so that sets of the result count as bags.
    ``hashes`` must be sorted and a plain column."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, i + 1 - F.array_position(hashes, h).cast("int")))


def simhash(hashes: Column) -> Column:
    """64 bits; each is the sign of the sum over all hashes. These must differ, as those of
    :func:`counted` do: one that is repeated would outweigh the others."""
    total = lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.getbit(h, b).cast("int") * 2 - 1)
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        F.lit(0).cast("bigint"),
        lambda a, b: a.bitwiseOR(F.when(total(b) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))),
    )


def block(fingerprint: Column, number: int) -> Column:
    width = BITS // BLOCKS
    return F.shiftrightunsigned(fingerprint, number * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def flips() -> list[int]:
    """All changes of a block by so few bits that a fingerprint within the radius has at
    least one block that differs by no more."""
    width, few = BITS // BLOCKS, RADIUS // BLOCKS
    return [x for x in range(1 << width) if x.bit_count() <= few]


def sized(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The table, marked for broadcasting if it was counted to be small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    scratch: Scratch | None = None,
) -> DataFrame:
    """(doc_id, item_id, first_word, words, similarity) for each item found in a document,
    with the best window; of equals the first one in which a shingle of an item of that length
    stands at its place, else the first one. Words are counted from 0.

    Texts are compared in lower case, by words between white space. Windows have as many
    words as the item, cut at the ends of the document. An item of fewer than five words is
    one shingle, its whole sequence. Items and documents without words, null texts among
    them, match nothing; rows without an id are compared like others and keep a null id.
    Repeated rows give one result for each pair of ids; empty tables an empty result.
    Further columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    bench = items.select(F.col(item_id).alias("item_id"), _words(F.col(item_text)).alias("words"))
    # Written, so that the filters below see columns and do not repeat their making.
    bench = bench.select("*", F.size("words").alias("n"), F.monotonically_increasing_id().alias("item"))
    bench = scratch.save("items", bench)
    bench = bench.where("n > 0").select("item_id", "item", "n", F.least("n", F.lit(SHINGLE)).alias("k"), "words")
    found = None
    for k in sorted(r["k"] for r in bench.select("k").distinct().collect()) or [SHINGLE]:  # five lengths at most
        part = _leaks(docs, bench.where(F.col("k") == k), doc_id, text, k, scratch)
        found = part if found is None else found.unionByName(part)
    return found


def _in_blocks(df: DataFrame, *columns: str) -> DataFrame:
    """Each fingerprint once for each block, with its value. Never null, so nothing has to be
    filtered before a join."""
    each = [F.struct(F.lit(b).alias("block"), F.coalesce(block(F.col("print"), b), F.lit(0)).alias("value")) for b in range(BLOCKS)]
    return df.select("*", F.explode(F.array(*each)).alias("b")).select(*columns, "print", "b.block", "b.value")


def _spots(body: DataFrame, k: int) -> DataFrame:
    """Each place of a text with the hash of its shingle."""
    # The outer form keeps the words from being made a second time to see that there are some.
    spots = body.select("*", F.explode_outer(F.when(F.col("size") >= k, F.expr(f"sequence(0, size - {k})"))).alias("spot"))
    return spots.select("*", F.xxhash64(*[F.get("words", F.col("spot") + j) for j in range(k)]).alias("hash"))


def _met_by_row(body: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """The places of texts that meet a shingle of the items, where these are too many to
    broadcast: hashes alone are shuffled, a text's places come back to it in one row, and only then
    its words are beside them."""
    thin = _spots(body, k).where("spot is not null").select("row", "spot", "hash")
    met = thin.join(places, "hash").groupBy("row").agg(F.collect_list(F.struct("spot", "n", "at")).alias("met"))
    return body.join(met, "row").select("doc_id", "words", "size", F.inline("met"))


def _leaks(docs: DataFrame, bench: DataFrame, doc_id: str, text: str, k: int, scratch: Scratch) -> DataFrame:
    bench = bench.select("item_id", "item", "n", _shingles(F.col("words"), F.col("n"), k).alias("hashes"))
    bench = bench.select("*", F.sort_array("hashes").alias("sorted"))
    bench = bench.select("item_id", "item", "n", "hashes", counted(F.col("sorted")).alias("bag"))
    items = scratch.save("prints", bench.select("*", simhash(F.col("bag")).alias("print")))
    # Shingles of the items of one length, with the places where they stand first in an item.
    places = (
        items.select("item", "n", F.posexplode("hashes").alias("at", "hash"))
        .groupBy("item", "n", "hash")
        .agg(F.min("at").alias("at"))
        .groupBy("hash", "n")
        .agg(F.collect_set("at").alias("at"))
    )
    places = scratch.save("places", places)
    body = docs.select(F.col(doc_id).alias("doc_id"), _words(F.col(text)).alias("words"))
    body = body.select("*", F.size("words").alias("size"))
    if places.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        met = _spots(body, k).join(F.broadcast(places), "hash")
    else:
        met = _met_by_row(scratch.save("body", body.select("*", F.monotonically_increasing_id().alias("row"))), places, k)
    # A stretch has 2n words from a multiple of n on and holds the windows that start in its
    # first half, the first one also those cut by the start of the text. The windows over a
    # shingle start in two halves at most.
    half = lambda start: F.floor(F.greatest(start, F.lit(0)) / F.col("n")).cast("int")
    halves = F.array_distinct(F.array(half(F.col("spot") - F.col("n") + k), half(F.col("spot"))))
    stretches = (
        met.where("spot is not null")
        .select("doc_id", "n", "size", "words", "spot", "at", F.explode(halves).alias("half"))
        .select("doc_id", "n", "spot", "at", "size", "words", (F.col("half") * F.col("n")).alias("from"))
        .select(
            "doc_id",
            "n",
            "from",
            F.struct((F.col("spot") - F.col("from")).alias("spot"), "at").alias("spot"),
            F.least(F.col("size") - F.col("from"), 2 * F.col("n")).alias("reach"),
            F.slice("words", F.col("from") + 1, 2 * F.col("n")).alias("words"),
        )
        .groupBy("doc_id", "n", "from", "reach", "words")
        .agg(F.collect_set("spot").alias("spots"))
    )
    stretches = stretches.select("*", _shingles(F.col("words"), F.col("reach"), k).alias("hashes"))
    # At 75 percent that many shingles of the window stand in the item, so in some item as long.
    enough = lambda both, many: (100 + LIKE) * both >= LIKE * (many - k + 1 + F.col("n") - k + 1)

    def window(start: Column) -> Column:
        first = F.greatest(start, F.lit(0))
        return F.struct(start.alias("start"), first.alias("first"), (F.least(start + F.col("n"), F.col("reach")) - first).alias("many"))

    def likely(w: Column) -> Column:
        inside = F.filter("spots", lambda x: (x["spot"] >= w["first"]) & (x["spot"] <= w["first"] + w["many"] - k))
        return (w["many"] >= k) & enough(F.size(inside), w["many"])

    starts = F.sequence(F.when(F.col("from") == 0, 1 - F.col("n")).otherwise(F.lit(0)), F.least(F.col("n"), F.col("reach")) - 1)
    # A stretch with too few shingles for the shortest window that could be alike has none.
    rich = 100 * F.size("spots") >= LIKE * (F.col("n") - k + 1)
    laid = F.when(rich, F.filter(F.transform(starts, window), likely))
    windows = stretches.select("doc_id", "n", "from", "hashes", "spots", F.explode_outer(laid).alias("w")).where("w is not null")
    windows = windows.select(
        "doc_id",
        "n",
        (F.col("from") + F.col("w.first")).alias("first"),
        F.col("w.many").alias("many"),
        F.exists("spots", lambda x: F.array_contains(x["at"], x["spot"] - F.col("w.start"))).alias("placed"),
        F.slice("hashes", F.col("w.first") + 1, F.col("w.many") - k + 1).alias("hashes"),
    )
    windows = windows.select("*", F.sort_array("hashes").alias("sorted"))
    windows = windows.select("doc_id", "n", "first", "many", "placed", counted(F.col("sorted")).alias("bag"))
    # Never null, or the join below would first filter by it, making its bag once for each bit.
    windows = windows.select("*", F.coalesce(simhash(F.col("bag")), F.lit(0)).alias("print"))

    changes = F.explode(F.array(*[F.lit(x) for x in flips()])).alias("change")
    near = _in_blocks(items, "item", "n").select("*", changes)
    near = near.select("item", "n", "print", "block", F.col("value").bitwiseXOR(F.col("change")).alias("value"))
    asked = _in_blocks(windows, "doc_id", "n", "first", "many", "placed", "bag")
    q, i = asked.alias("q"), sized(scratch.save("near", near)).alias("i")
    differ = lambda b: F.bit_count(block(F.col("q.print"), b).bitwiseXOR(block(F.col("i.print"), b)))
    # A pair that meets in several blocks is taken in the first of them.
    earliest = F.coalesce(*[F.when(differ(b) <= RADIUS // BLOCKS, F.lit(b)) for b in range(BLOCKS)])
    pairs = q.join(i, (F.col("q.n") == F.col("i.n")) & (F.col("q.block") == F.col("i.block")) & (F.col("q.value") == F.col("i.value"))).where(
        (F.bit_count(F.col("q.print").bitwiseXOR(F.col("i.print"))) <= RADIUS) & (earliest == F.col("q.block"))
    )
    pairs = pairs.select("q.doc_id", "i.item", "q.first", "q.many", "q.placed", F.col("q.bag").alias("window_bag"))
    pairs = pairs.join(items.select("item", "item_id", "bag"), "item").select(
        "doc_id",
        "item_id",
        "first",
        "many",
        "placed",
        F.size(F.array_intersect("window_bag", "bag")).alias("both"),
        (F.size("window_bag") + F.size("bag")).alias("sum"),
    )
    share = F.col("both") / (F.col("sum") - F.col("both"))
    best = F.max(
        F.when(
            (100 + LIKE) * F.col("both") >= LIKE * F.col("sum"),
            F.struct(share.alias("similarity"), F.col("placed"), (-F.col("first")).alias("first"), F.col("many").alias("many")),
        )
    )
    return (
        pairs.groupBy("doc_id", "item_id")
        .agg(best.alias("best"))
        .where("best is not null")
        .select(
            "doc_id",
            "item_id",
            (-F.col("best.first")).cast("long").alias("first_word"),
            F.col("best.many").cast("long").alias("words"),
            F.col("best.similarity").alias("similarity"),
        )
    )
