"""Mixing sources to target weights (problem 7).

Each source's tokens, its documents in a pseudorandom order, are packed into blocks of a fixed length. The source
counts of every output shard are multinomial draws conditioned on exact totals (hypergeometric ones, drawn source by source
at any size); a shard's slots are mapped through pseudorandom permutations of the source's block indices, a new one for each
repetition, and joined to the blocks by index. No block, and so no document, is used more often than its source allows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.session import cut

#: Slots that are written out from one row.
CHUNK = 65_536
#: Documents of a source that are ordered together, about.
SEGMENT = 50_000


def blocks(sized: DataFrame, block: int, seed: int) -> DataFrame:
    """(source, block, doc_id, tok_start, tok_end): the documents' parts in the blocks of their source.

    sized: doc_id, source, n_tokens; documents without tokens have no part. Order within a source is by hash. A hot
    source is cut into segments of hash ranges whose token sums give the offsets, so no task orders a whole source.
    """
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    d = sized.where("n_tokens > 0").select("source", "doc_id", "n_tokens", h.alias("h"))
    segments = max(1, -(-d.count() // SEGMENT))
    d = d.withColumn("seg", F.pmod(F.shiftrightunsigned("h", 20), F.lit(segments)))
    sums = d.groupBy("source", "seg").agg(F.sum("n_tokens").alias("t"))
    offsets = sums.select("source", "seg", (F.sum("t").over(Window.partitionBy("source").orderBy("seg")) - F.col("t")).alias("base"))
    w = Window.partitionBy("source", "seg").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("before", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).join(offsets, ["source", "seg"]).withColumn("at", F.col("base") + F.col("before"))
    parts = placed.select("source", "doc_id", "n_tokens", "at", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n_tokens") - 1) / block))).alias("block"))
    start = F.greatest(F.col("block") * block - F.col("at"), F.lit(0))
    return parts.select("source", "block", "doc_id", start.alias("tok_start"), F.least((F.col("block") + 1) * block - F.col("at"), F.col("n_tokens")).alias("tok_end"))


def totals(shares: dict[str, float], repeats: dict[str, int], have: dict[str, int]) -> dict[str, int]:
    """Blocks to draw of each source: the largest mix in which every source with blocks holds its share.

    Sources without blocks get none and the others' shares grow in proportion. Rounding is to the largest remainder.
    """
    live = {s: w for s, w in shares.items() if w > 0 and have.get(s, 0) > 0 and repeats[s] > 0}
    if not live:
        return {}
    weight = sum(live.values())
    size = math.floor(min(have[s] * repeats[s] * weight / w for s, w in live.items()) + 1e-9)
    exact = {s: size * w / weight for s, w in live.items()}
    out = {s: math.floor(x) for s, x in exact.items()}
    for s in sorted(live, key=lambda s: (out[s] - exact[s], s)):
        if sum(out.values()) < size and out[s] < have[s] * repeats[s]:
            out[s] += 1
    return out


def hypergeometric(good: int, bad: int, sample: int, rng: np.random.Generator) -> int:
    """How many good ones a sample drawn without replacement holds, by rejection from a ratio of uniforms.

    The time doesn't depend on the sizes, and Python's integers don't overflow; the log-gamma function is exact to some
    1e-3 at 1e12, which is the only approximation.
    """
    if min(good, sample) == 0:
        return 0
    if bad == 0 or sample == good + bad:
        return min(good, sample)
    size, less, m = good + bad, min(good, bad), min(sample, good + bad - sample)
    more = size - less
    p = less / size
    centre, spread = m * p + 0.5, math.sqrt((size - m) * m / (size - 1) * p * (1 - p) + 0.5)
    width = 1.7155277699214135 * spread + 0.8989161620588988  # 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e)
    log_p = lambda k: math.lgamma(k + 1) + math.lgamma(less - k + 1) + math.lgamma(m - k + 1) + math.lgamma(more - m + k + 1)
    peak = log_p((m + 1) * (less + 1) // (size + 2))
    top = min(min(m, less) + 1, math.floor(centre + 16 * spread))
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        w = centre + width * (v - 0.5) / u
        if 0 <= w < top and 2 * math.log(u) <= peak - log_p(math.floor(w)):
            break
    k = math.floor(w)
    k = m - k if good > bad else k
    return k if m == sample else good - k


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n - 1 applied to i: six Feistel rounds, walked on until the result is below n."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out, todo = i.astype(np.uint64), np.arange(len(i))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in range(6):
            h = (right + np.uint64((key + r * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(29))) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def mix(sized: DataFrame, targets: DataFrame, block: int = 256, seed: int = 17, shards: int = 256) -> DataFrame:
    """(shard, slot, source, repetition, block, doc_id, tok_start, tok_end): the mix, a row for each document part.

    sized: doc_id, source, n_tokens; targets: source, target_share, max_repeats (a closed list of sources, collected).
    Null sources and sources without a target are left out, as are targets without documents. The same seed gives the
    same mix. The mix is dealt to `shards` output shards of equal size (to one slot), empty ones where it has fewer slots.
    """
    spark = sized.sparkSession
    goal = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source IS NOT NULL").select("source", "target_share", "max_repeats").collect()}
    wanted = sized.where(F.col("source").isin(list(goal) or [""]))
    parts = cut(blocks(cut(wanted.select("doc_id", "source", "n_tokens")), block, seed))
    have = {r["source"]: r["n"] for r in parts.groupBy("source").agg((F.max("block") + 1).alias("n")).collect()}
    n = totals({s: g[0] for s, g in goal.items()}, {s: g[1] for s, g in goal.items()}, have)
    names, rng = sorted(n), np.random.default_rng(seed)
    left, size = dict(n), sum(n.values())
    draws, first = [], dict.fromkeys(names, 0)
    for k in range(shards):
        slots, rest = size * (k + 1) // shards - size * k // shards, sum(left.values())
        for s in names:
            rest -= left[s]
            c = hypergeometric(left[s], rest, slots, rng)
            slots, left[s] = slots - c, left[s] - c
            if c:
                draws.append((k, s, first[s], first[s] + c))
                first[s] += c
    turns = [(s, r, have[s], int(rng.integers(0, 2**62))) for s in names for r in range(goal[s][1])]
    turn = spark.createDataFrame(turns, "source string, repetition int, n long, key long")
    of = spark.createDataFrame([(s, have[s]) for s in names], "source string, n long")
    # a draw's slots are written out in chunks, which are spread over the tasks first
    chunks = spark.createDataFrame(draws, "shard int, source string, lo long, hi long").select("shard", "source", "hi", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(CHUNK).cast("long"))).alias("lo"))
    chunks = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "source", "lo").join(F.broadcast(of), "source")
    slots = chunks.select("shard", "source", "n", F.explode(F.sequence("lo", F.least("hi", F.col("lo") + CHUNK) - 1)).alias("slot")).withColumn("repetition", F.floor(F.col("slot") / F.col("n")).cast("int")).drop("n")
    slots = slots.join(F.broadcast(turn), ["source", "repetition"]).select("shard", "source", "repetition", "slot", "n", "key")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, size_of, keys = (batch.column(c).to_numpy() for c in (3, 4, 5))
            out = np.zeros(len(slot), np.int64)
            for key in np.unique(keys):
                rows = keys == key
                length = int(size_of[rows][0])
                out[rows] = permuted(slot[rows] % length, length, int(key))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out)], names=["shard", "source", "repetition", "slot", "block"])

    slots = slots.mapInArrow(place, "shard int, source string, repetition int, slot long, block long")
    return slots.join(parts, ["source", "block"]).select("shard", "slot", "source", "repetition", "block", "doc_id", "tok_start", "tok_end")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, most_uses, max_repeats) of every target."""
    per_doc = mixed.groupBy("source", "doc_id", "tok_start").agg(F.sum(F.col("tok_end") - F.col("tok_start")).alias("t"), F.count(F.lit(1)).alias("uses"))
    got = per_doc.groupBy("source").agg(F.sum("t").alias("tokens"), F.max("uses").alias("most_uses"))
    all_tokens = got.agg(F.sum("tokens")).first()[0] or 1
    r = targets.select("source", "target_share", "max_repeats").join(got, "source", "left")
    return r.select("source", "target_share", F.coalesce(F.col("tokens") / F.lit(all_tokens), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats")
