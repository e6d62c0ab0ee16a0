import itertools
import math
import random

import pytest

from netloom.operators import graph as R
from netloom.operators import joins as J
from netloom.operators import topology as P

PTS = "id long, x double, y double"


def union_find(ids, edges):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_chain_star_and_noise(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(random.randrange(200, 300), random.randrange(200, 300)) for _ in range(60)] + [(5, 5), (7, 8), (8, 7)]
    ids = sorted({v for e in edges for v in e} | {999})
    got = {r["id"]: r["component"] for r in R.connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    assert got == union_find(ids, edges)
    assert R.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def points(n, span, seed):
    random.seed(seed)
    return [(i, float(random.randrange(span)), float(random.randrange(span))) for i in range(n)]


def test_dbscan_brute_force(spark):
    p = points(80, 60, 4)
    near = lambda a, b: (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 36
    core = {a[0] for a in p if sum(near(a, b) for b in p) >= 4}
    comp = union_find(core, [(a[0], b[0]) for a, b in itertools.combinations(p, 2) if a[0] in core and b[0] in core and near(a, b)])
    want = {a[0]: comp.get(a[0]) or (comp[a[0]] if a[0] in core else min([comp[b[0]] for b in p if b[0] in core and near(a, b)], default=None)) for a in p}
    got = {r["id"]: r["cluster"] for r in R.dbscan(spark.createDataFrame(p, PTS), 6.0, 4).collect()}
    assert got == want


def test_nearest_any_ties_and_far(spark):
    right = [(2, 0.0, 3.0), (1, 0.0, -3.0), (9, 5000.0, 0.0)]
    left = [(1, 0.0, 0.0), (2, 9000.0, 0.0), (3, None, 0.0)]
    got = {r["left_id"]: (r["right_id"], r["d"]) for r in J.nearest_any(spark.createDataFrame(left, PTS), spark.createDataFrame(right, PTS), 1.0).collect()}
    assert got == {1: (1, 3.0), 2: (9, 4000.0)}
    assert J.nearest_any(spark.createDataFrame(left, PTS), spark.createDataFrame([], PTS), 1.0).count() == 0


def test_nearest_seed_is_dijkstra(spark):
    random.seed(5)
    edges = [(random.randrange(40), random.randrange(40), float(random.randrange(1, 9))) for _ in range(70)]
    seeds = {3: "B", 17: "A", 30: "C"}
    best = {s: (0.0, n) for s, n in seeds.items()}
    for _ in range(60):
        for a, b, w in edges:
            for u, v in ((a, b), (b, a)):
                if u in best and (v not in best or (best[u][0] + w, best[u][1]) < best[v]):
                    best[v] = (best[u][0] + w, best[u][1])
    got = {r["id"]: (r["dist"], r["seed"]) for r in R.nearest_seed(spark.createDataFrame(edges, "a long, b long, w double"), spark.createDataFrame(list(seeds.items()), "id long, seed string")).collect()}
    assert got == best


def test_assignment_brute_force(spark):
    random.seed(6)
    e = {(random.randrange(6), random.randrange(6)): float(random.randrange(1, 50)) for _ in range(14)}
    rows = [(a, b, d) for (a, b), d in e.items()]
    df = spark.createDataFrame(rows, "left_id long, right_id long, d double")
    got = [(r["left_id"], r["right_id"], r["d"]) for r in R.best_assignment(df).collect()]
    assert len({g[0] for g in got}) == len({g[1] for g in got}) == len(got)
    best = max((len(s), -sum(x[2] for x in s)) for k in range(7) for s in itertools.combinations(rows, k) if len({x[0] for x in s}) == len({x[1] for x in s}) == k)
    assert (len(got), -sum(g[2] for g in got)) == best
    taken, out = set(), []
    for a, b, d in sorted(rows, key=lambda r: (round(r[2], 3), r[0], r[1])):
        if ("l", a) not in taken and ("r", b) not in taken:
            taken |= {("l", a), ("r", b)}
            out.append((a, b, d))
    assert sorted(tuple(r) for r in R.greedy_matching(df).collect()) == sorted(out)


LINE = "id long, points array<struct<x:double,y:double>>, layer string"
line = lambda i, *p, layer="c": (i, [{"x": float(x), "y": float(y)} for x, y in p], layer)


def test_split_and_chain(spark):
    lines = spark.createDataFrame([line(1, (0, 0), (10, 0)), line(2, (10.2, 0), (20, 0)), line(3, (20, 0), (20, 10)), line(4, (50, 50)), line(5, (20, 0), (30, 0))], LINE)
    nodes = spark.createDataFrame([(1, 5.0, 1.0), (2, 100.0, 100.0)], PTS)
    parts = {(r["line_id"], r["part"]): [(p["x"], p["y"]) for p in r["points"]] for r in P.split_at_nodes(lines, nodes, 2.0).collect()}
    assert parts[1, 0] == [(0, 0), (5, 0)] and parts[1, 1] == [(5, 0), (10, 0)] and (2, 1) not in parts and parts[4, 0] == [(50, 50)]
    got = sorted((r["n_lines"], round(r["length"], 3)) for r in P.chains(lines, nodes, 0.5, 2.0).collect())
    # the first piece ends at the node; the second goes on into line 2 over the weld; three lines meet at (20, 0)
    assert got == [(1, 5.0), (1, 10.0), (1, 10.0), (2, 15.0)]


def test_gap_bridge_needs_direction_and_layer(spark):
    lines = spark.createDataFrame([line(1, (0, 0), (10, 0)), line(2, (13, 0), (20, 0)), line(3, (10, 3), (10, 9)), line(4, (23, 0), (30, 0), layer="other")], LINE)
    none = spark.createDataFrame([], PTS)
    tight = {(r["left_id"], r["right_id"]) for r in P.gap_bridges(lines, none, 5.0, 0.866).collect()}
    assert tight == {("1:1", "2:0")}
    free = {(r["left_id"], r["right_id"]) for r in P.gap_bridges(lines, none, 5.0, 0.866, free=True).collect()}
    assert ("2:1", "4:0") in free and len(free) == 2


def test_endpoint_repair_grades_and_collapse(spark):
    lines = spark.createDataFrame([line(1, (0, 1), (0, -1)), line(2, (100, 0), (120, 0)), line(3, (2, 0), (20, 0))], LINE)
    nodes = spark.createDataFrame([("A", 0.0, 0.0), ("B", 110.0, 0.0)], "code string, x double, y double")
    got = {(r["line_id"], r["end"]): (r["code"], r["grade"], r["moved"]) for r in P.repair_endpoints(lines, nodes, 5.0, 15.0).collect()}
    assert got[1, 0] == ("A", "SNAP", True) and got[1, 1] == ("A", "SNAP", False)  # both on one node would leave no line
    assert got[2, 0] == ("B", "ATTR_ONLY", False) and got[3, 0] == ("A", "SNAP", True) and got[3, 1] == ("A", "FLOATING", False)
    with pytest.raises(ValueError):
        P.repair_endpoints(lines, nodes, 20.0, 15.0)


def test_label_assignment_statuses(spark):
    labels = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 0.0), (3, 1.0, 0.0), (4, 500.0, 0.0)], PTS)
    targets = spark.createDataFrame([(10, 0.0, 2.0), (20, 45.0, 0.0), (21, 55.0, 0.0)], PTS)
    got = {r["label_id"]: (r["target_id"], r["status"]) for r in P.assign_labels(labels, targets, 15.0).collect()}
    assert got == {1: (10, "selected"), 2: (None, "multiple_optima"), 3: (None, "assignment_conflict"), 4: (None, "outside_tolerance")}


def test_tiles_split_hot(spark):
    pts = points(300, 1000, 9) + [(1000 + i, float(i % 7), float(i // 7)) for i in range(200)]
    t = R.split_tiles(R.tiles(spark.createDataFrame(pts, PTS), 250), 60).groupBy("tile").count().collect()
    assert sum(r["count"] for r in t) == 500 and max(r["count"] for r in t) <= 60
    same = R.split_tiles(R.tiles(spark.createDataFrame([(i, 1.0, 1.0) for i in range(9)], PTS), 3), 3)
    assert same.count() == 9


def test_near_duplicate_lines_at_cell_corners(spark):
    # one corner straddles a line of the plain grid in x and of the grid shifted by half a cell in y, the next the other way round
    random.seed(6)
    tol = 1.0
    corners = [(64.0 * i + dx, 64.0 * j + dy) for i in range(-2, 3) for j in range(-2, 3) for dx in (0.0, 32.0, 7.0) for dy in (0.0, 32.0, 7.0)]
    off = [(x + random.uniform(-0.6, 0.6), y + random.uniform(-0.6, 0.6)) for x, y in corners for _ in range(3)]
    lines = [(k, "l", [(x, y), (x + 5.0, y + 9.0)], None if k % 3 else "t") for k, (x, y) in enumerate(off)]
    d = lambda p, q: math.dist(p[2][0], q[2][0])
    gone = {q[0] for p in lines for q in lines if (p[3] is None, p[0]) < (q[3] is None, q[0]) and d(p, q) < tol}
    df = spark.createDataFrame(lines, "id long, layer string, points array<struct<x double, y double>>, text string")
    assert {r["id"] for r in J.duplicate_lines(df, tol).collect()} == {r[0] for r in lines} - gone


def test_large_components_are_assigned_exactly(spark):
    from netloom.operators.drift import assign

    random.seed(8)
    n = 150  # one crowd, 22 500 edges
    cost = [[round(random.uniform(0, 25), 3) for _ in range(n)] for _ in range(n)]
    rows = [(i, j, cost[i][j]) for i in range(n) for j in range(n)]
    got = R.best_assignment(spark.createDataFrame(rows, "left_id long, right_id long, d double")).collect()
    assert len({r["left_id"] for r in got}) == len({r["right_id"] for r in got}) == len(got) == n
    assert sum(r["d"] for r in got) == pytest.approx(sum(cost[i][j] for i, j in enumerate(assign(cost))))


def test_sparse_assignment_brute_force():
    for seed in range(300):
        rng = random.Random(seed)
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        e = {(i, j): float(rng.randrange(9)) for i in range(n) for j in range(m) if rng.random() < 0.5}
        got = R.assign_sparse([[(j, d) for (a, j), d in e.items() if a == i] for i in range(n)], m)
        pairs = [(i, j) for i, j in enumerate(got) if j >= 0]
        assert len({j for _, j in pairs}) == len(pairs)
        best = max((len(s), -sum(e[x] for x in s)) for k in range(min(n, m) + 1) for s in itertools.combinations(e, k) if len({x[0] for x in s}) == len({x[1] for x in s}) == k)
        assert (len(pairs), -sum(e[x] for x in pairs)) == best
