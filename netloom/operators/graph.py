"""Components, clusters, paths and assignments as loops of joins; lineage is cut in the shared folder each round."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.spatial import near_pairs
from netloom.session import cut, release


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component): component is the least id in it. edges: a, b; vertices: id, for vertices without edges.

    Alternating large-star and small-star rounds: a hub's neighbours are regrouped around its least neighbour, so no
    round multiplies a group's pairs. Ends when a round changes nothing.
    """
    e = cut(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("m").alias("u"), F.col("y").alias("v")).where("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v").distinct()
        old, e = e, cut(small)
        release(old)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    found = e.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(e.select(F.col("u").alias("id"), F.col("u").alias("component"))).distinct()
    if vertices is None:
        return found
    return vertices.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def proximity_clusters(points: DataFrame, radius: float) -> DataFrame:
    """(id, cluster): points (id, x, y) linked by steps of at most radius; single points are clusters of their own."""
    return connected_components(near_pairs(points, "id", "x", "y", radius).select(F.col("left_id").alias("a"), F.col("right_id").alias("b")), points).withColumnRenamed("component", "cluster")


def dbscan(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    """(id, cluster): density clusters named by their least core id; NULL is noise. A border point joins the least cluster it touches."""
    pairs = cut(near_pairs(points, "id", "x", "y", eps))
    both = pairs.select(F.col("left_id").alias("id"), F.col("right_id").alias("other")).unionByName(pairs.select(F.col("right_id").alias("id"), F.col("left_id").alias("other")))
    dense = both.groupBy("id").agg((F.count(F.lit(1)) + 1).alias("n")).where(F.col("n") >= min_points).select("id")
    core = cut(dense if min_points > 1 else points.select("id").distinct())
    links = pairs.join(core.withColumnRenamed("id", "left_id"), "left_id", "left_semi").join(core.withColumnRenamed("id", "right_id"), "right_id", "left_semi")
    of_core = cut(connected_components(links.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")), core))
    border = both.join(core, "id", "left_anti").join(of_core.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("component"))
    return points.select("id").distinct().join(of_core.unionByName(border), "id", "left").select("id", F.col("component").alias("cluster"))


def nearest_seed(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, seed, dist): each reachable vertex with its nearest seed by path length, the least seed on ties.

    edges: a, b, w >= 0, walked both ways; seeds: id, seed. Each round relaxes the edges of the vertices that changed.
    """
    both = cut(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"), "w")).where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.min("w").alias("w")))
    best = cut(seeds.select("id", F.struct(F.lit(0.0).alias("dist"), F.col("seed").cast("string").alias("seed")).alias("b")).groupBy("id").agg(F.min("b").alias("b")))
    front, joined = best, None
    while True:
        reach = front.join(both, front["id"] == both["x"]).select(F.col("y").alias("id"), F.struct((F.col("b.dist") + F.col("w")).alias("dist"), F.col("b.seed").alias("seed")).alias("n")).groupBy("id").agg(F.min("n").alias("n"))
        old, joined = joined, cut(best.join(reach, "id", "full_outer").select("id", "b", "n", (F.col("n").isNotNull() & (F.col("b").isNull() | (F.col("n") < F.col("b")))).alias("better")))
        best = joined.select("id", F.when(F.col("better"), F.col("n")).otherwise(F.col("b")).alias("b"))
        front = joined.where("better").select("id", F.col("n").alias("b"))
        if old is not None:  # nothing reads the round before any more
            release(old)
        if front.isEmpty():
            return best.select("id", "b.seed", "b.dist")


def tag_edges(edges: DataFrame, domains: DataFrame) -> DataFrame:
    """edges with `domain`: that of both ends, LINK where they differ, of the one end that has one, NULL of none. domains: id, seed."""
    d = lambda k: domains.select(F.col("id").alias(k), F.col("seed").alias(f"{k}_seed"))
    j = edges.join(d("a"), "a", "left").join(d("b"), "b", "left")
    return j.withColumn("domain", F.when(F.col("a_seed") != F.col("b_seed"), "LINK").otherwise(F.coalesce("a_seed", "b_seed"))).drop("a_seed", "b_seed")


def greedy_matching(candidates: DataFrame, one_set: bool = False) -> DataFrame:
    """(left_id, right_id, d): pairs taken in order of (d rounded to a millimetre, left_id, right_id), each side once.

    With one_set both sides are ids of one set, and each id is taken once in either place. In each round every pair
    that is first at both of its ends is taken; that gives the same pairs as one pass in order.
    """
    key = lambda side: F.concat(F.lit("" if one_set else side), F.col(f"{side}_id").cast("string"))
    order = F.struct(F.round("d", 3).alias("r"), "left_id", "right_id")
    rest = cut(candidates.select("left_id", "right_id", "d", order.alias("o"), key("left").alias("__l"), key("right").alias("__r")))
    taken = None
    while not rest.isEmpty():
        best = rest.select(F.explode(F.array("__l", "__r")).alias("e"), "o").groupBy("e").agg(F.min("o").alias("m"))
        at = lambda side: best.select(F.col("e").alias(side), F.col("m").alias(f"{side}_m"))  # noqa: E731, B023
        first = cut(rest.join(at("__l"), "__l").join(at("__r"), "__r").where("o = __l_m AND o = __r_m").select("left_id", "right_id", "d", "__l", "__r"))
        taken = first if taken is None else taken.unionByName(first)
        gone = first.select(F.explode(F.array("__l", "__r")).alias("e"))
        old, rest = rest, cut(rest.join(gone, F.col("__l") == F.col("e"), "left_anti").join(gone, F.col("__r") == F.col("e"), "left_anti"))
        release(old)
    return (taken if taken is not None else candidates).select("left_id", "right_id", "d")


def assign_sparse(edges: list[list[tuple[int, float]]], n_right: int) -> list[int]:
    """The right of each left, or -1: most pairs and, among those, least total distance.

    edges: for each left its (right, d >= 0). Lefts come in one by one, each by the cheapest alternating path (Dijkstra over
    potentials) to a free right or else to the left that is best given up; room is that of the edges.
    """
    top = max((d for e in edges for _, d in e), default=0.0)
    give_up = 2.0 * (min(len(edges), n_right) + 1) * top + 1.0  # dearer than any path saves
    u, v, right_of, left_of = [0.0] * len(edges), [0.0] * n_right, [-1] * len(edges), [-1] * n_right
    for start in range(len(edges)):
        dist: dict[int, float] = {}
        prev: dict[int, int] = {}
        done, heap, i, at = [], [], start, 0.0
        seen: set[int] = set()
        least, loser = float("inf"), start
        while True:
            if at + give_up - u[i] < least:
                least, loser = at + give_up - u[i], i
            for j, d in edges[i]:
                to = at + d - u[i] - v[j]
                if j not in seen and to < dist.get(j, float("inf")):
                    dist[j], prev[j] = to, i
                    heapq.heappush(heap, (to, j))
            while heap and heap[0][1] in seen:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= least:
                end, j = least, right_of[loser]
                right_of[loser] = -1
                break
            at, j = heapq.heappop(heap)
            if left_of[j] < 0:
                end = at
                break
            seen.add(j)
            done.append((j, left_of[j]))
            i = left_of[j]
        u[start] += end
        for k, owner in done:
            u[owner] += end - dist[k]
            v[k] -= end - dist[k]
        while j >= 0:
            i = prev[j]
            left_of[j], right_of[i], j = i, j, right_of[i]
    return right_of


def best_assignment(candidates: DataFrame) -> DataFrame:
    """(left_id, right_id, d): the one-to-one assignment with most pairs and, among those, least total distance.

    The cost is a sum, so every component of the candidate graph is solved by itself, exactly, however large it is; a
    task holds the edges of one component.
    """
    c = cut(candidates.select("left_id", "right_id", "d").groupBy("left_id", "right_id").agg(F.min("d").alias("d")))
    key = lambda side, col: F.concat(F.lit(side), F.col(col).cast("string"))
    comp = connected_components(c.select(key("l", "left_id").alias("a"), key("r", "right_id").alias("b")))
    parts = cut(c.join(comp, key("l", "left_id") == comp["id"]).drop("id"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        lefts, rights = sorted(pdf.left_id.unique()), sorted(pdf.right_id.unique())
        at_l, at_r = {v: i for i, v in enumerate(lefts)}, {v: i for i, v in enumerate(rights)}
        edges: list[list[tuple[int, float]]] = [[] for _ in lefts]
        for a, b, d in zip(pdf.left_id, pdf.right_id, pdf.d):
            edges[at_l[a]].append((at_r[b], d))
        got = [(lefts[i], rights[j], dict(edges[i])[j]) for i, j in enumerate(assign_sparse(edges, len(rights))) if j >= 0]
        return pd.DataFrame(got, columns=["left_id", "right_id", "d"])

    kinds = ", ".join(f"{f} {c.schema[f].dataType.simpleString()}" for f in ("left_id", "right_id", "d"))
    return parts.groupBy("component").applyInPandas(solve, kinds)


def isolated_nodes(nodes: DataFrame, code: str, edges: DataFrame, ends: list[str]) -> DataFrame:
    """Nodes whose code no end of an edge names."""
    from netloom.functions.keys import ref_key

    used = edges.select(F.explode(F.array(*[ref_key(e) for e in ends])).alias("__c")).where("__c IS NOT NULL").distinct()
    return nodes.join(used, ref_key(code) == F.col("__c"), "left_anti")


def merge_groups(groups: DataFrame) -> DataFrame:
    """(group, merged): groups that share members, directly or through others, get one number. groups: group, member."""
    edges = groups.select(F.concat(F.lit("g"), F.col("group").cast("string")).alias("a"), F.concat(F.lit("m"), F.col("member").cast("string")).alias("b"))
    c = connected_components(edges).where("id LIKE 'g%'")
    return c.select(F.expr("substring(id, 2)").alias("group"), F.expr("substring(component, 2)").alias("merged"))


def tiles(points: DataFrame, size: int, most: int = 50) -> DataFrame:
    """points (x, y) with `tile` T<row>_<col>: a grid of about `size` points a tile by the extent's proportions, at most `most` either way."""
    s = points.agg(F.count(F.lit(1)), *[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()
    n, x0, x1, y0, y1 = s[0], *(v or 0.0 for v in s[1:])
    w, h = (x1 - x0) or 1.0, (y1 - y0) or 1.0
    need = max(1.0, n / size)
    cols = max(1, min(most, round((need * w / h) ** 0.5)))
    rows = max(1, min(most, round((need * h / w) ** 0.5)))
    place = lambda c, lo, span, k: F.least(F.lit(k - 1), F.floor((F.col(c) - lo) / span * k)).cast("int")
    return points.withColumn("tile", F.concat(F.lit("T"), place("y", y0, h, rows).cast("string"), F.lit("_"), place("x", x0, w, cols).cast("string")))


def split_tiles(tiled: DataFrame, most: int, rounds: int = 10) -> DataFrame:
    """tiled (x, y, tile) with tiles of more than `most` points split in four by the middle of their extent, again and again.

    `_<row><col>` is added to the tile's name each time; tiles of coincident points stay.
    """
    for _ in range(rounds):
        s = tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("__n"), F.min("x").alias("__x0"), F.max("x").alias("__x1"), F.min("y").alias("__y0"), F.max("y").alias("__y1")).where((F.col("__n") > most) & ((F.col("__x0") < F.col("__x1")) | (F.col("__y0") < F.col("__y1"))))
        s = cut(s.select("tile", ((F.col("__x0") + F.col("__x1")) / 2).alias("__mx"), ((F.col("__y0") + F.col("__y1")) / 2).alias("__my")))
        if s.isEmpty():
            return tiled
        j = tiled.join(s, "tile", "left")
        part = F.concat(F.lit("_"), (F.col("y") > F.col("__my")).cast("int").cast("string"), (F.col("x") > F.col("__mx")).cast("int").cast("string"))
        tiled = cut(j.withColumn("tile", F.when(F.col("__mx").isNull(), F.col("tile")).otherwise(F.concat("tile", part))).drop("__mx", "__my"))
    return tiled
