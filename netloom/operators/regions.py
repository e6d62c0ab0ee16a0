"""Which regions hold a point (problem 4): ear-clipped triangles under a bounding-volume hierarchy.

Rings become triangles by ear clipping. The triangles' centroids get Morton codes; every second pair of bits of the
code is one level of the hierarchy, and a node's box bounds the triangles below it. Points descend level by level:
the root's children are tested from a literal of at most 16 boxes, deeper levels by an equi-join on the parent node,
so that no plan has a nested loop. The last level meets the triangles themselves and tests them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.spatial import finite
from netloom.session import broadcast_if_small, cut

#: Bits of a centroid's Morton code for each axis.
DEPTH = 16
#: Triangles a lowest node should hold about.
LEAF = 16


def _orient(a: tuple, b: tuple, c: tuple) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def ear_clip(ring: list[tuple[float, float]]) -> list[tuple] | None:
    """Triangles of a simple ring, closed or open, in either direction; None if no ear is left (it crosses itself).

    Repeated vertices are merged and collinear ones clipped as ears without area, which are kept so that their border stays
    covered. Fewer than three vertices give no triangles.
    """
    p = [q for k, q in enumerate(ring) if k == 0 or q != ring[k - 1]]
    while len(p) > 1 and p[0] == p[-1]:
        p.pop()
    if len(p) < 3:
        return []
    if sum(_orient(p[0], p[k], p[k + 1]) for k in range(1, len(p) - 1)) < 0:
        p.reverse()
    out = []
    while len(p) > 3:
        for i in range(len(p)):
            a, b, c = p[i - 1], p[i], p[(i + 1) % len(p)]
            turn = _orient(a, b, c)
            if turn < 0:
                continue
            if turn > 0 and any(q not in (a, b, c) and _orient(a, b, q) >= 0 and _orient(b, c, q) >= 0 and _orient(c, a, q) >= 0 for q in p):
                continue
            if turn == 0 and (c[0] - b[0]) * (b[0] - a[0]) + (c[1] - b[1]) * (b[1] - a[1]) < 0:
                return None  # a spike that turns back on itself
            out.append((a, b, c))
            p.pop(i)
            break
        else:
            return None
    out.append(tuple(p))
    return out


def _crosses(ring: list[tuple]) -> bool:
    """Whether two sides that don't adjoin cross or touch; quadratic in the vertices of one ring."""
    p = [q for k, q in enumerate(ring) if k == 0 or q != ring[k - 1]]
    while len(p) > 1 and p[0] == p[-1]:
        p.pop()
    n = len(p)
    for i in range(n):
        a, b = p[i], p[(i + 1) % n]
        for j in range(i + 2, n - (i == 0)):
            c, d = p[j], p[(j + 1) % n]
            if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
                continue
            if _orient(a, b, c) * _orient(a, b, d) < 0 and _orient(c, d, a) * _orient(c, d, b) < 0:
                return True
    return False


def triangles(regions: DataFrame, id_col: str, ring_col: str) -> DataFrame:
    """(region_id, ax .. cy, ring, xmin, xmax, ymin, ymax): a row for each triangle.

    A ring that crosses itself can't be clipped; it comes as one row with `ring` set, to be tested by the even-odd
    rule. Null rings, rings with a null or infinite vertex and rings of fewer than three vertices hold nothing.
    """
    kind = regions.schema[id_col].dataType.simpleString()
    xy = "array<struct<x:double,y:double>>"
    schema = f"region_id {kind}, ax double, ay double, bx double, by double, cx double, cy double, ring {xy}, xmin double, xmax double, ymin double, ymax double"
    src = regions.select(F.col(id_col).alias("region_id"), F.transform(ring_col, lambda v: F.struct(v["x"].cast("double").alias("x"), v["y"].cast("double").alias("y"))).alias("ring")).where("size(ring) >= 3")

    def clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), []
            for k, ring in enumerate(batch.column(1).to_pylist()):
                p = [(v["x"], v["y"]) if v else (None, None) for v in ring]
                if any(c is None or not abs(c) < float("inf") for q in p for c in q):
                    continue
                tris = None if _crosses(p) else ear_clip(p)
                if tris is None:
                    xs, ys = [q[0] for q in p], [q[1] for q in p]
                    rows.append((k, *[None] * 6, ring, min(xs), max(xs), min(ys), max(ys)))
                for t in tris or ():
                    xs, ys = [q[0] for q in t], [q[1] for q in t]
                    rows.append((k, *[c for q in t for c in q], None, min(xs), max(xs), min(ys), max(ys)))
            cols = list(zip(*rows)) or [()] * 12
            ring_type = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
            arrays = [ids.take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.float64()) for c in cols[1:7]], pa.array(cols[7], ring_type), *[pa.array(c, pa.float64()) for c in cols[8:]]]
            yield pa.RecordBatch.from_arrays(arrays, names=["region_id", "ax", "ay", "bx", "by", "cx", "cy", "ring", "xmin", "xmax", "ymin", "ymax"])

    return src.mapInArrow(clip, schema)


def _spread(c: Column) -> Column:
    """16 bits with a zero between each two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return c


def in_triangle(px: Column, py: Column) -> Column:
    """Inside or on the border, by three orientations relative to the point."""
    side = lambda p, q: (F.col(f"{p}x") - px) * (F.col(f"{q}y") - py) - (F.col(f"{p}y") - py) * (F.col(f"{q}x") - px)
    s = [side("a", "b"), side("b", "c"), side("c", "a")]
    return ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)) | ((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd rule, border included."""
    n = F.size(ring)
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("p"), F.get(ring, (i + 1) % n).alias("q")))

    def turn(s: Column) -> Column:
        return (s["p"]["x"] - px) * (s["q"]["y"] - py) - (s["p"]["y"] - py) * (s["q"]["x"] - px)

    def on(s: Column) -> Column:
        between = lambda k, v: (F.least(s["p"][k], s["q"][k]) <= v) & (v <= F.greatest(s["p"][k], s["q"][k]))
        return (turn(s) == 0) & between("x", px) & between("y", py)

    def up(s: Column) -> Column:
        return ((s["p"]["y"] > py) != (s["q"]["y"] > py)) & ((turn(s) > 0) == (s["q"]["y"] > s["p"]["y"]))

    return F.exists(sides, on) | (F.size(F.filter(sides, up)) % 2 == 1)


def containing_regions(points: DataFrame, point_id: str, x: str, y: str, regions: DataFrame, region_id: str, ring: str) -> DataFrame:
    """(point_id, region_id) of every region that holds a point or has it on its border, each pair once.

    Points without finite x and y are in no region. Empty tables give no rows. Other columns are ignored. A crowded
    node is split by AQE's skew join where its level is shuffled.
    """
    spark = points.sparkSession
    kinds = f"point_id {points.schema[point_id].dataType.simpleString()}, region_id {regions.schema[region_id].dataType.simpleString()}"
    tri = cut(triangles(regions, region_id, ring))
    s = tri.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(a) for f, c, a in ((F.min, "xmin", "x0"), (F.max, "xmax", "x1"), (F.min, "ymin", "y0"), (F.max, "ymax", "y1"))]).first()
    if not s["n"]:
        return spark.createDataFrame([], kinds)
    side = max(s["x1"] - s["x0"], s["y1"] - s["y0"]) or 1.0
    at = lambda lo, hi, z: F.floor(((F.col(lo) + F.col(hi)) / 2 - z) / side * ((1 << DEPTH) - 1)).cast("bigint")
    coded = tri.withColumn("m", _spread(at("xmin", "xmax", s["x0"])).bitwiseOR(F.shiftleft(_spread(at("ymin", "ymax", s["y0"])), 1)))
    levels = 1
    while levels < DEPTH // 2 and 16**levels * LEAF < s["n"]:
        levels += 1
    node = lambda level: F.shiftright(F.col("m"), 2 * DEPTH - 4 * level)
    boxes = lambda level: coded.groupBy(node(level).alias("node")).agg(*[f(c).alias(c) for f, c in ((F.min, "xmin"), (F.max, "xmax"), (F.min, "ymin"), (F.max, "ymax"))])
    top = boxes(1).collect()  # at most 16 rows
    px, py = F.col("px"), F.col("py")
    inside = (px >= F.col("xmin")) & (px <= F.col("xmax")) & (py >= F.col("ymin")) & (py <= F.col("ymax"))
    found = points.select(F.col(point_id).alias("point_id"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).where(finite(px, py))
    roots = F.array_compact(F.array(*[F.when((px >= r["xmin"]) & (px <= r["xmax"]) & (py >= r["ymin"]) & (py <= r["ymax"]), F.lit(r["node"])) for r in top]))
    found = found.select("point_id", "px", "py", F.explode(roots).alias("at"))
    for level in range(2, levels + 1):
        below = boxes(level).withColumn("at", F.shiftright("node", 4))
        found = found.join(broadcast_if_small(below), "at").where(inside).select("point_id", "px", "py", F.col("node").alias("at"))
    leaves = broadcast_if_small(coded.withColumn("at", node(levels)).drop("m"))
    exact = F.when(F.col("ring").isNull(), in_triangle(px, py)).otherwise(in_ring(px, py, F.col("ring")))
    return found.join(leaves, "at").where(inside & exact).select("point_id", "region_id").distinct()
