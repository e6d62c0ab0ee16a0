"""What operators store and shuffle where far more lines than spots are given."""

import os
import random

from netloom.operators import topology as P

LINE = "id long, points array<struct<x:double,y:double>>, layer string"


def stored(spark, run):
    """(rows, bytes that run left in the checkpoint folder)."""
    from netloom.session import shared_dir

    top = shared_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(top) for f in fs if os.path.exists(os.path.join(d, f)))
    before = size()
    rows = run().collect()
    return rows, size() - before


def fan(spark, n=20_000, sites=20, far=30.0):
    """n lines from a few sites to a few nodes."""
    random.seed(1)
    site = [(random.uniform(0, 400), random.uniform(0, 400)) for _ in range(sites)]
    node = [(x + random.uniform(5, far), y + random.uniform(5, far)) for x, y in site]
    rows = [(i, [{"x": p[0], "y": p[1]} for p in (site[i % sites], node[i // sites % sites])], "c") for i in range(n)]
    return spark.createDataFrame(rows, LINE), site, node


def test_endpoint_repair_stores_spots_not_ends(spark):
    lines, site, node = fan(spark)
    nodes = spark.createDataFrame([(f"N{k}", x, y) for k, (x, y) in enumerate(node)], "code string, x double, y double")
    rows, size = stored(spark, lambda: P.repair_endpoints(lines, nodes, 5.0, 15.0))
    assert len(rows) == 40_000 and all(r["d"] == 0 and r["grade"] == "SNAP" for r in rows if r["end"] == 1)
    near = {k: min(((x - a) ** 2 + (y - b) ** 2) ** 0.5 for a, b in node) for k, (x, y) in enumerate(site)}
    assert all(abs(r["d"] - near[r["line_id"] % 20]) < 1e-9 for r in rows if r["end"] == 0)
    assert size < 200_000


def test_split_lines_keeps_lines_where_they_are(spark, monkeypatch):
    random.seed(2)
    node = [(random.uniform(0, 60), random.uniform(0, 60)) for _ in range(60)]
    shape = lambda i: [node[i % 60]] if i % 17 == 0 else [(random.uniform(0, 60), random.uniform(0, 60)) for _ in range(2 + i % 3)] if i % 5 else [node[i % 60]] * 2
    rows = [(i, [{"x": x, "y": y} for x, y in shape(i)], "c") for i in range(300)] + [(300, [], "c"), (301, None, "c")]
    lines, nodes = spark.createDataFrame(rows, LINE), spark.createDataFrame(node, "x double, y double")
    want = {(i, k): p for i, pts, _ in rows for k, p in enumerate(P._pieces([(v["x"], v["y"]) for v in pts or ()], sorted(node), 2.0, 0.01))}
    for most in (1 << 20, 0):  # nodes sent to the tasks, nodes joined
        monkeypatch.setattr(P, "NODE_BYTES", most)
        df = P.split_at_nodes(lines, nodes, 2.0)
        got = {(r["line_id"], r["part"]): [(p["x"], p["y"]) for p in r["points"]] for r in df.collect()}
        assert got == want
        assert ("Exchange" in df._jdf.queryExecution().executedPlan().toString()) == (not most)


def test_gap_bridges_as_one_pass_over_all_pairs(spark):
    random.seed(3)
    spot = [(random.uniform(0, 40), random.uniform(0, 40)) for _ in range(30)]
    line = lambda: [random.choice(spot), random.choice(spot)]
    lines = [(i, line(), "ab"[i % 2] if i % 7 else None) for i in range(150)]
    nodes = [(random.uniform(0, 40), random.uniform(0, 40)) for _ in range(3)] + spot[:5]
    dist = lambda p, q: ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5
    ends = [(f"{i}:{e}", i, layer, p[-e], [(a - b) / (dist(*p) or 1) for a, b in zip(p[-e], p[e - 1])]) for i, p, layer in lines for e in (0, 1)]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p], k) for i, p, k in lines], LINE)
    nd = lambda p: min(d if d <= 6.0 else 1e9 for d in (dist(p, n) for n in nodes))
    for free in (False, True):
        pairs = [(round(d, 3), a[0], b[0]) for a in ends for b in ends if a[0] < b[0] and a[1] != b[1] and (d := dist(a[3], b[3])) <= 6.0 and (free or a[2] == b[2] and -sum(u * v for u, v in zip(a[4], b[4])) >= 0.5 and d < nd(a[3]) and d < nd(b[3]))]
        taken, want = set(), set()
        for _, a, b in sorted(pairs):
            if a not in taken and b not in taken:
                taken |= {a, b}
                want.add((a, b))
        rows, size = stored(spark, lambda: P.gap_bridges(df, spark.createDataFrame(nodes, "x double, y double"), 6.0, 0.5, free))
        assert {(r["left_id"], r["right_id"]) for r in rows} == want and len(want) > 15


def test_gap_bridges_stores_spots_not_ends(spark):
    lines, _, node = fan(spark)
    rows, size = stored(spark, lambda: P.gap_bridges(lines, spark.createDataFrame(node, "x double, y double"), 5.0, 0.5))
    assert rows and size < 200_000


def test_duplicate_lines_of_one_corner(spark):
    from netloom.operators import joins as J

    # all boxes begin at (0, 0), so lines can't be told by that corner; copies and near copies repeat
    random.seed(4)
    base = [[(0.0, 0.0)] + [(random.uniform(0, 990), random.uniform(0, 500)) for _ in range(30)] for _ in range(60)]
    lines = [(k * 10, "l", p, None) for k, p in enumerate(base)] + [(k * 10 + 1, "l", p, "t") for k, p in enumerate(base)]
    lines += [(k * 10 + 2, "l", [(x + 0.0003, y) for x, y in p], "") for k, p in enumerate(base)] + [(k * 10 + 3, "m", p, "") for k, p in enumerate(base)]
    lines += [(5000, "l", [], ""), (5001, None, base[0], ""), (5002, "l", None, "")]
    df = spark.createDataFrame([(i, k, None if p is None else [{"x": x, "y": y} for x, y in p], t) for i, k, p, t in lines], "id long, layer string, points array<struct<x:double,y:double>>, text string")
    out = J.duplicate_lines(df, 0.001)
    want = {k * 10 + j for k in range(60) for j in (1, 3)} | {5000, 5001, 5002}
    assert {r["id"] for r in out.collect()} == want


def test_nearest_line_lists_no_pairs(spark):
    from netloom.operators import pipeline as L

    random.seed(5)
    p = lambda n: [(random.uniform(0, 90), random.uniform(0, 90)) for _ in range(n)]
    spans, lines = [(i, p(1 + i % 3)) for i in range(60)], [(1000 - i, p(1 + i % 4)) for i in range(40)] + [(2000, [(300.0, 0.0), (300.0, 90.0)])]
    spans += [(900, [(303.0, 10.0), (340.0, 10.0)]), (901, [(310.0, 10.0), (340.0, 10.0)])]
    df = lambda rows: spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in q]) for i, q in rows], "id long, points array<struct<x:double,y:double>>")
    seg = lambda q: list(zip(q, q[1:])) or [(q[0], q[0])]

    def apart(q, r):
        import numpy as np

        one = lambda s, t: float(L._segments_apart(*s[0], *s[1], *(np.array([v]) for e in t for v in e))[0])
        return min(one(s, t) for s in seg(q) for t in seg(r))

    want = {i: min((d, k) for k, r in lines if (d := apart(q, r)) <= 4.0) for i, q in spans if any(apart(q, r) <= 4.0 for _, r in lines)}
    out = L.nearest_line(df(spans), df(lines), 4.0)
    assert {r["span_id"]: (r["d"], r["line_id"]) for r in out.collect()} == want and want[900] == (3.0, 2000) and 901 not in want
    assert "SortMergeJoin" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "HashJoin" not in plan


def chained(P, lines, nodes, weld, capture):
    """Chains of lines (id, points) as sets of pieces, by brute force: (least piece, pieces, length, points where there is one piece)."""
    dist = lambda p, q: ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5
    pieces = {f"{str(i).zfill(12)}.{str(k).zfill(4)}": p for i, pts in lines for k, p in enumerate(P._pieces(pts, sorted(nodes), capture, 0.01)) if len(p) >= 2}
    ends = [(k, e, p[-e]) for k, p in pieces.items() for e in (0, 1)]
    up = list(range(len(ends)))

    def find(up, i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(ends)):
        for b in range(a):
            if dist(ends[a][2], ends[b][2]) <= weld:
                up[find(up, a)] = find(up, b)
    junction = {}
    for i in range(len(ends)):
        junction.setdefault(find(up, i), []).append(ends[i])
    names = sorted(pieces)
    link = list(range(len(names)))
    for met in junction.values():
        if len(met) == 2 and met[0][0] != met[1][0] and all(dist(m[2], n) > capture for m in met for n in nodes):
            a, b = (find(link, names.index(m[0])) for m in met)
            link[max(a, b)] = min(a, b)
    groups = {}
    for i, k in enumerate(names):
        groups.setdefault(names[find(link, i)], []).append(k)
    return {(min(g), len(g), pieces[g[0]] == pieces[g[0]] and tuple(pieces[g[0]]) if len(g) == 1 else None) for g in groups.values()}


def test_chains_by_brute_force(spark, monkeypatch):
    random.seed(7)
    p = lambda: (random.uniform(0, 100), random.uniform(0, 100))
    nodes = [p() for _ in range(25)]
    spot = [p() for _ in range(60)] + nodes[:5]
    jitter = lambda q: (q[0] + random.choice((0, 0, 0.3, -0.6)), q[1] + random.choice((0, 0, 0.4)))
    lines = [(10**13 + i // 2 * 10 + i % 2, [jitter(random.choice(spot)) for _ in range(2 if i % 4 else 3)]) for i in range(60)]
    lines += [(7, [(0.0, 200.0), (100.0, 200.0), (100.0, 300.0), (0.0, 300.0), (0.0, 200.0)]), (8, [(5.0, 5.0)]), (9, [(1.0, 1.0), (1.0, 1.0)])]
    # a ring cut in the middle meets itself at its start; ends a cut lies near are held
    nodes += [(99.0, 301.0), (500.0, 504.8)]
    lines += [(10, [(400.0, 500.0), (500.1, 499.7)]), (11, [(500.1, 499.7), (600.0, 400.0)]), (12, [(400.0, 500.0), (600.0, 500.0)])]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in q], "c") for i, q in lines], LINE)
    want = chained(P, lines, nodes, 0.5, 5.0)
    assert sum(n > 1 for _, n, _ in want) >= 3 and len({k for k, _, _ in want}) == len(want)
    for most in (1 << 20, 0):
        monkeypatch.setattr(P, "NODE_BYTES", most)
        got = P.chains(df, spark.createDataFrame(nodes, "x double, y double"), 0.5, 5.0).collect()
        assert {(r["chain"], r["n_lines"]) for r in got} == {w[:2] for w in want} and len(got) == len(want)
        flat = {r["chain"]: tuple((q["x"], q["y"]) for q in r["points"]) for r in got if r["n_lines"] == 1}
        assert all(flat[k] == tuple(q for i, q in enumerate(v) if i == 0 or q != v[i - 1]) for k, n, v in want if n == 1)
        assert all(abs(r["length"] - sum(((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2) ** 0.5 for a, b in zip(r["points"], r["points"][1:]))) < 1e-9 for r in got)


def test_chains_bridge_gaps(spark):
    lines = [(1, [(0.0, 0.0), (10.0, 0.0)], "c"), (2, [(13.0, 0.0), (20.0, 0.0)], "c"), (3, [(20.3, 0.0), (30.0, 0.0)], "c"), (4, [(33.0, 0.0), (40.0, 0.0)], "other")]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in q], k) for i, q, k in lines], LINE)
    none = spark.createDataFrame([], "x double, y double")
    got = lambda how: sorted((r["chain"], r["n_lines"]) for r in P.chains(df, none, 0.5, 5.0, how).collect())
    name = lambda i: f"{i:012d}.0000"
    assert got("off") == [(name(1), 1), (name(2), 2), (name(4), 1)]
    assert got("constrained") == [(name(1), 3), (name(4), 1)]
    assert got("free") == [(name(1), 4)]


def test_chains_store_spots_not_pieces(spark):
    lines, _, node = fan(spark)
    rows, size = stored(spark, lambda: P.chains(lines, spark.createDataFrame(node, "x double, y double"), 0.5, 5.0))
    assert len(rows) >= 20_000 and size < 200_000
