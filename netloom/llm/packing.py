"""Filling containers of a fixed token capacity (problem 6).

Dynamic programming over the global histogram of lengths chooses the bucket boundaries that minimise padding; every
item is taken as long as its bucket's boundary. Token-budget batches form over the buckets' counts: containers take as
many items of the longest bucket as fit and what room is left goes to the best fitting shorter buckets. (Batches of one
bucket alone leave more empty; the report has both figures.) The driver handles the histogram only; items find their
place by their rank in their bucket.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.session import cut

#: Rows of the offset table up to which it is broadcast.
BROADCAST_OFFSETS = 200_000


def bucket_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least padding over the histogram (length -> count)."""
    sizes = np.array(sorted(histogram), np.int64)
    m = len(sizes)
    if m <= buckets:
        return sizes.tolist()
    n = np.array([histogram[s] for s in sizes.tolist()], np.float64)
    cum_n, cum_t = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * sizes)])
    # padding of items i..j-1 in one bucket bounded by the length of item j-1; the best i never falls as j grows, so each
    # round halves the range of j and looks between its neighbours' choices only
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    choice = []
    for _ in range(buckets):
        new, arg = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        todo = [(1, m, 0, m - 1)]
        while todo:
            lo, hi, a, z = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(z, j - 1) + 1)
            cost = best[i] + sizes[j - 1] * (cum_n[j] - cum_n[i]) - (cum_t[j] - cum_t[i])
            k = int(np.argmin(cost))
            new[j], arg[j] = cost[k], a + k
            todo += [(lo, j - 1, a, a + k), (j + 1, hi, a + k, z)]
        choice.append(arg)
        best = new
    bounds, j = [], m
    for arg in reversed(choice):
        if j == 0:
            break
        bounds.append(int(sizes[j - 1]))
        j = int(arg[j])
    return sorted(bounds)


def batches_of_one_bucket(counts: dict[int, int], capacity: int) -> int:
    """Containers needed if each holds items of one bucket only."""
    return sum(-(-n // (capacity // size)) for size, n in counts.items() if size)


def compose(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Placements (bucket, first rank, first container, items each) and the number of containers, longest buckets first.

    Containers of like contents stay together as one range of numbers, so the work grows with the number of buckets,
    not with the items.
    """
    placed: list[tuple[int, int, int, int]] = []
    room: list[int] = []  # sorted free sizes with open containers
    open_at: dict[int, list[tuple[int, int]]] = {}
    used = 0

    def put(free: int, first: int, n: int) -> None:
        if free > 0 and n > 0:
            if free not in open_at:
                bisect.insort(room, free)
                open_at[free] = []
            open_at[free].append((first, n))

    for size in sorted((s for s in counts if s > 0), reverse=True):
        left, rank = counts[size], 0
        while left:
            k = bisect.bisect_left(room, size)
            if k < len(room):
                free = room[k]
                first, n = open_at[free].pop()
                if not open_at[free]:
                    del open_at[free]
                    room.pop(k)
                each = min(free // size, left)
                take = min(n, left // each)
                put(free, first + take, n - take)
            else:
                each = min(capacity // size, left)
                take = left // each
                first, free = used, capacity
                used += take
            placed.append((size, rank, first, each))
            put(free - each * size, first, take)
            rank += take * each
            left -= take * each
    return placed, used


def pieces(sized: DataFrame, id_col: str, capacity: int) -> DataFrame:
    """(doc_id, piece_no, tok_start, n_tokens): texts as they are, larger ones cut into full pieces and a rest."""
    last = F.floor((F.greatest(F.col("n_tokens"), F.lit(1)) - 1) / capacity).cast("int")
    p = sized.select(F.col(id_col).alias("doc_id"), F.col("n_tokens").alias("__n"), F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    start = F.col("piece_no").cast("bigint") * capacity
    return p.select("doc_id", "piece_no", start.alias("tok_start"), F.least(F.col("__n") - start, F.lit(capacity)).cast("int").alias("n_tokens"))


def pack(sized: DataFrame, id_col: str, capacity: int, buckets: int = 128) -> tuple[DataFrame, dict[str, float]]:
    """(doc_id, piece_no, tok_start, n_tokens, bucket, container_id) of every text, and the figures of the packing.

    sized: id_col and n_tokens. Nulls, empty texts and repeated rows are placed like all others: a text of no tokens
    goes to container 0, repeated rows each find a place of their own. An empty table has no containers.
    """
    spark = sized.sparkSession
    items = cut(pieces(sized, id_col, capacity).withColumn("__part", F.spark_partition_id()))
    hist = {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    bounds = bucket_bounds({s: n for s, n in hist.items() if s > 0}, buckets) if any(hist) else []
    counts = dict.fromkeys(bounds, 0)
    for s, n in hist.items():
        if s:
            counts[bounds[bisect.bisect_left(bounds, s)]] += n
    placed, used = compose(counts, capacity)
    tokens = sum(s * n for s, n in hist.items())
    figures = {"texts_and_pieces": float(sum(hist.values())), "tokens": float(tokens), "containers": float(used), "least_containers": float(-(-tokens // capacity)), "fill_share": tokens / (used * capacity) if used else 1.0, "fill_share_one_bucket": tokens / (batches_of_one_bucket(counts, capacity) * capacity) if used else 1.0, "padding_share": sum(b * n for b, n in counts.items()) / tokens - 1 if tokens else 0.0}
    edges = spark.sparkContext.broadcast((np.array(bounds, np.int64), {b: tuple(np.array(c, np.int64) for c in zip(*[(r, f, e) for s, r, f, e in placed if s == b])) for b in bounds}))

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = edges.value[0]
        for batch in batches:
            n = batch.column(3).to_numpy(zero_copy_only=False)
            at = np.where(n > 0, b[np.minimum(np.searchsorted(b, n), len(b) - 1)], 0) if len(b) else np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=["doc_id", "piece_no", "tok_start", "n_tokens", "__part", "bucket"])

    kind = items.schema["doc_id"].dataType.simpleString()
    base = f"doc_id {kind}, piece_no int, tok_start long, n_tokens int"
    items = items.mapInArrow(bucketed, f"{base}, __part int, bucket int")
    # rank in the bucket: offset of the stored part, then the place within it; a hot length is spread over all parts
    off = items.groupBy("__part", "bucket").agg(F.count(F.lit(1)).alias("n"))
    off = cut(off.withColumn("__off", F.sum("n").over(Window.partitionBy("bucket").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__part", "bucket", F.coalesce("__off", F.lit(0)).alias("__off")))
    if off.count() <= BROADCAST_OFFSETS:
        off = F.broadcast(off)
    local = F.row_number().over(Window.partitionBy("__part", "bucket").orderBy("doc_id", "piece_no")) - 1
    ranked = items.withColumn("__local", local).join(off, ["__part", "bucket"]).select("doc_id", "piece_no", "tok_start", "n_tokens", "bucket", (F.col("__off") + F.col("__local")).alias("__rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = edges.value[1]
        for batch in batches:
            bucket, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            out = np.zeros(len(rank), np.int64)
            for b in np.unique(bucket):
                if b:
                    ranks, first, each = table[int(b)]
                    rows = bucket == b
                    k = np.searchsorted(ranks, rank[rows], side="right") - 1
                    out[rows] = first[k] + (rank[rows] - ranks[k]) // each[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out)], names=["doc_id", "piece_no", "tok_start", "n_tokens", "bucket", "container_id"])

    return ranked.mapInArrow(place, f"{base}, bucket int, container_id long"), figures
