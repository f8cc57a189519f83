"""Joins by key on large tables: reducing a side before it is shuffled, and splitting keys
that hold more rows than a task should."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are sent to every task as they are; above that as a filter of a byte each; above
#: that not at all.
MOST_KEYS, MOST_FILTERED = 1_000_000, 64_000_000
#: Rows of one key that a task may hold; a key with more is dealt into parts.
MOST_ROWS = 1_000_000

#: Words of 64 bits in a block of the filter, bits of a key in its block, bits kept per key.
_WORDS, _MARKS, _BITS_PER_KEY = 1024, 3, 8
#: Standard error of the sketch that counts keys.
_SKETCH_ERROR = 0.02
_PART = "_part"
#: Hashes by which rows are counted before their keys are.
_HASHES = 4096
#: A table that Spark takes to be smaller has no key worth splitting, whatever its rows.
_SMALL_BYTES = 64 << 20


def _is_small(df: DataFrame) -> bool:
    """Whether the optimizer puts all of a table below the size from which splitting pays."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < _SMALL_BYTES


@dataclass(frozen=True)
class KeySet:
    """Keys of one column, none null, and a number they do not exceed, by all odds, if it is known."""

    keys: DataFrame
    number: int | None = None
    blocks: DataFrame | None = None

    @classmethod
    def of(cls, rows: DataFrame, key: str, stored: bool, keep: Callable[[DataFrame], DataFrame] | None = None) -> KeySet:
        """The keys that ``rows`` have; counted if these are ``stored``: the rows, which their
        files tell, and the keys themselves, by a sketch that shuffles none of them, only if there are
        too many rows to know by that. ``keep`` stores the filter of many keys, for more than one use."""
        keys = rows.select(key).where(F.col(key).isNotNull())
        if not stored:
            return cls(keys)
        number = rows.count()
        if number > MOST_KEYS:
            about = keys.agg(F.approx_count_distinct(key, _SKETCH_ERROR)).first()[0]
            number = min(number, int(about * (1 + 4 * _SKETCH_ERROR)) + 1)
        is_filter = MOST_KEYS < number <= MOST_FILTERED
        return cls(keys, number, keep(key_filter(keys, key, number)) if keep and is_filter else None)

    def reduce(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` without rows whose key a later join by key would drop anyway.

        Few keys are broadcast, so that nothing of the rest leaves its task. Many are
        broadcast as a filter, which lets about 3 % of the others pass. Both are semi-joins, which Spark
        puts below the groups, unions and joins that ``df`` is made by, ahead of their shuffles, where
        the key allows. With more than that, or if they were not counted, it is a shuffled join,
        broadcast only if Spark finds it small. Rows with a null key go.
        """
        (key,) = self.keys.columns
        keys = self.keys.select(F.col(key).alias(column))
        # Equal keys of other types have other hashes, which the join's own casts do not see.
        as_join = df.schema[column].dataType != keys.schema[column].dataType
        if self.number is None or self.number > (MOST_KEYS if as_join else MOST_FILTERED):
            return df.join(keys, column, "left_semi")
        if self.number <= MOST_KEYS:
            return df.join(F.broadcast(keys.distinct()), column, "left_semi")
        known = key_filter(keys, column, self.number) if self.blocks is None else self.blocks
        blocks, held = _held(column, known, self.number)
        return df.where(F.col(column).isNotNull()).join(blocks, held, "left_semi")


def _blocks(number: int) -> int:
    return max(1, -(-number * _BITS_PER_KEY // (64 * _WORDS)))


def _bit(mark: Column) -> Column:
    """The mark's bit within its word."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), mark.bitwiseAND(F.lit(63)).cast("int"))


def _hashed(key: Column) -> Column:
    """What the bits of a key within its block are cut from."""
    return F.xxhash64(key, F.lit(1)).bitwiseAND(F.lit((1 << 16 * _MARKS) - 1))


def _marks(hashed: Column) -> Column:
    """The bits of a key within its block."""
    return F.array(*[F.shiftrightunsigned(hashed, 16 * i).bitwiseAND(F.lit(64 * _WORDS - 1)) for i in range(_MARKS)])


def _block(key: Column, number: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_blocks(number)))


def key_filter(keys: DataFrame, key: str, number: int) -> DataFrame:
    """A Bloom filter in blocks, ``(block, words)``, over about ``number`` keys: a key sets three
    bits of one block of 65,536, which has a row of its own.

    Only a hash of each key is shuffled, once a task, to its block; the words are made there. A block that no
    key is in has no row.
    """
    hashes = keys.select(_block(F.col(key), number).alias("block"), _hashed(F.col(key)).alias("_hash"))
    blocks = hashes.groupBy("block").agg(F.collect_set("_hash").alias("_hashes"))

    def set_bit(word: Column, bits: Column) -> Column:
        return F.struct(word.cast("int").alias("word"), bits.alias("bits"))

    none = F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), lambda w: set_bit(w, F.lit(0).cast("bigint")))
    marks = F.flatten(F.transform("_hashes", lambda h: _marks(h)))
    marked = F.transform(marks, lambda m: set_bit(F.shiftright(m, 6), _bit(m)))
    words = (
        blocks.select("block", F.inline(F.concat(none, marked)))
        .groupBy("block", "word")
        .agg(F.bit_or("bits").alias("bits"))
    )
    in_order = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return words.groupBy("block").agg(F.transform(in_order, lambda w: w["bits"]).alias("words"))


def _held(column: str, known: DataFrame, number: int) -> tuple[DataFrame, Column]:
    """The filter's blocks for a broadcast, and whether they may hold the key in ``column``."""
    words = F.col("_words")
    has = F.forall(
        _marks(_hashed(F.col(column))),
        lambda m: F.get(words, F.shiftright(m, 6).cast("int")).bitwiseAND(_bit(m)) != 0,
    )
    blocks = F.broadcast(known.select(F.col("block").alias("_block"), F.col("words").alias("_words")))
    return blocks, (_block(F.col(column), number) == F.col("_block")) & has


def passing(df: DataFrame, column: str, known: DataFrame, number: int) -> DataFrame:
    """Rows whose key the filter may hold: all that it holds, and few others. The filter is broadcast, a byte
    for each of its keys."""
    blocks, held = _held(column, known, number)
    return df.where(F.col(column).isNotNull()).join(blocks, held).select(*df.columns)


@dataclass(frozen=True)
class Split:
    """How the rows of heavy keys are dealt: ``heavy`` has ``(key, _parts)``, None splits nothing.

    The side with many rows of a key is dealt into the key's parts, the side with one row of a
    key (or few) is repeated for each. Joins, and chains of joins, are then on :attr:`on`, and
    no task gets more of a key than a part. The heavy keys are found once, and are at most one for every
    ``MOST_ROWS`` rows, so they can be broadcast. Rows are counted by a hash of the key first, which leaves a
    task as a few thousand sums; only keys whose hash has enough rows for a heavy key are counted themselves.
    """

    key: str
    heavy: DataFrame | None = None

    @classmethod
    def of(cls, rows: DataFrame, key: str, stage, name: str) -> Split:
        """A split by the counts of ``rows``, if ``stage`` stores results and the rows are many;
        none otherwise."""
        if not stage.stores or _is_small(rows):
            return cls(key)
        rows = rows.select(key, F.pmod(F.xxhash64(key), F.lit(_HASHES)).alias("_hash")).where(F.col(key).isNotNull())
        hashes = rows.groupBy("_hash").agg(F.count("*").alias("n")).where(F.col("n") > MOST_ROWS)
        hashes = stage(f"{name}_hashes", hashes.select("_hash"))
        if not hashes.limit(1).count():
            return cls(key)
        counted = rows.join(F.broadcast(hashes), "_hash", "left_semi").groupBy(key).agg(F.count("*").alias("n"))
        parts = F.ceil(F.col("n") / F.lit(MOST_ROWS)).cast("int")
        heavy = stage(name, counted.where(F.col("n") > MOST_ROWS).select(key, parts.alias("_parts")))
        return cls(key, heavy if heavy.limit(1).count() else None)

    @property
    def on(self) -> list[str]:
        return [self.key] if self.heavy is None else [self.key, _PART]

    def _parts(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.heavy), self.key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))

    def many(self, df: DataFrame) -> DataFrame:
        """Deals rows by a hash of all they hold, so that a lost task deals them the same again."""
        if self.heavy is None:
            return df
        part = F.pmod(F.xxhash64(*df.columns), F.col("_parts")).cast("int")
        return self._parts(df).withColumn(_PART, part).drop("_parts")

    def one(self, df: DataFrame) -> DataFrame:
        """Repeats rows for each part of their key."""
        if self.heavy is None:
            return df
        parts = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
        return self._parts(df).withColumn(_PART, parts).drop("_parts")

    def left_join_many(self, one: DataFrame, many: DataFrame) -> DataFrame:
        """``one`` left joined with ``many``, which may have any number of rows of a key.

        A heavy key has rows, so where one of its parts got none that is no missing match.
        """
        if self.heavy is None:
            return one.join(many, self.key, "left")
        right = self.many(many).withColumn("_met", F.lit(True))
        met = self.one(one).join(right, self.on, "left")
        is_heavy = F.broadcast(self.heavy.select(self.key, F.lit(True).alias("_heavy")))
        met = met.join(is_heavy, self.key, "left").where(F.col("_met").isNotNull() | F.col("_heavy").isNull())
        return met.drop(_PART, "_met", "_heavy")
