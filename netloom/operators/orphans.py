"""References to records that do not exist (problem 1).

A register-blocked Bloom filter of the parent keys is kept as a relation of 64-bit words: a key owns one word and
sets four bits of it. A reference whose bits are not all set names a parent that never existed, a definite orphan.
Only the filter-positive references reach the exact join, which also looks at when the parent was present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.session import broadcast_if_small

BITS_PER_KEY = 16
#: Words of the filter up to which it is broadcast (16 bytes each: 32 MB, some eight million keys). A larger one is joined on
#: the word by a shuffle, so it is never denser.
BROADCAST_WORDS = 1 << 21


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def _mask(key: Column) -> Column:
    """Four bits of 64, from a hash that is independent of the word's."""
    h = F.xxhash64(F.lit("mask"), key)
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, n).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12)).bitwiseOR(bit(18))


def bloom_words(parents: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """(word, bits) of the parents' keys, aggregated map-side first, and the number of words."""
    words = max(16, -(-n_keys * BITS_PER_KEY // 64))
    return parents.select(_word(F.col(key), words).alias("__word"), _mask(F.col(key)).alias("__m")).groupBy("__word").agg(F.bit_or("__m").alias("__bits")), words


def presence(parents: DataFrame, key: Column, start: Column, end: Column | None) -> DataFrame:
    """Disjoint intervals [p_from, p_to) in which a key has a parent; p_to NULL: never ends.

    Null keys and rows without a start are no parents; intervals with p_to <= p_from are empty. Repeated rows are
    combined map-side to one row for each (key, start) before the running maximum over a key's starts.
    """
    forever = F.lit("9999-12-31 00:00:00").cast("timestamp")
    end = forever if end is None else F.coalesce(end.cast("timestamp"), forever)
    rows = parents.select(key.alias("p_key"), start.cast("timestamp").alias("p_from"), end.alias("p_to")).where("p_key IS NOT NULL AND p_from < p_to").groupBy("p_key", "p_from").agg(F.max("p_to").alias("p_to"))
    w = Window.partitionBy("p_key").orderBy("p_from")
    opened = rows.withColumn("__new", F.coalesce(F.col("p_from") > F.max("p_to").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    return opened.withColumn("__island", F.sum(F.col("__new").cast("int")).over(w)).groupBy("p_key", "__island").agg(F.min("p_from").alias("p_from"), F.max("p_to").alias("p_to")).drop("__island")


def classify_references(refs: DataFrame, key: Column, at: Column, intervals: DataFrame) -> DataFrame:
    """`refs` with `ref_state`: 'none' (null or blank key), 'never' (the filter proves it), 'absent' or 'present'.

    refs may hold any columns but those beginning with `__`; its rows are all kept. A row with a key but without a
    time is 'absent' unless the filter already says 'never'. Empty parents make every key 'never'. intervals are read
    several times; give stored ones (see cut). Where they are too many to be broadcast, only the filter-positive
    references cross the network, on their key, and AQE splits hot keys.
    """
    n = intervals.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("p_key").alias("keys")).first()
    keyed = refs.withColumns({"__key": key, "__at": at.cast("timestamp")})
    words, n_words = bloom_words(intervals, "p_key", int(n["keys"]))
    # a hot reference key meets one word of a broadcast relation of bounded size: no shuffle, no skew
    words = F.broadcast(words) if n_words <= BROADCAST_WORDS else words
    keyed = keyed.withColumn("__word", _word(F.col("__key"), n_words)).join(words, "__word", "left").withColumn("__maybe", F.col("__key").isNotNull() & F.col("__bits").isNotNull() & (F.col("__bits").bitwiseAND(_mask(F.col("__key"))) == _mask(F.col("__key")))).drop("__word", "__bits")
    exact = intervals.select(F.col("p_key").alias("__pk"), F.col("p_from").alias("__pf"), F.col("p_to").alias("__pt"))
    small = broadcast_if_small(exact)
    during = (F.col("__at") >= F.col("__pf")) & (F.col("__at") < F.col("__pt"))
    # intervals of one key are disjoint, so a reference meets at most one of them and the left join keeps the row count
    if small is not exact:
        held = keyed.join(small, (F.when(F.col("__maybe"), F.col("__key")) == F.col("__pk")) & during, "left")
    else:
        held = keyed.where("__maybe").join(exact, (F.col("__key") == F.col("__pk")) & during, "left").unionByName(keyed.where("NOT __maybe"), allowMissingColumns=True)
    state = F.when(F.col("__key").isNull(), "none").when(~F.col("__maybe"), "never").when(F.col("__pk").isNull(), "absent").otherwise("present")
    return held.withColumn("ref_state", state).drop("__key", "__at", "__maybe", "__pk", "__pf", "__pt")
