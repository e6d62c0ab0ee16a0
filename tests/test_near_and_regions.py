import math
import random

import pytest

from netloom import session
from netloom.operators import regions as R
from netloom.operators.spatial import near_pairs


def brute(points, r):
    return {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(points) for b in points[i + 1 :] if a[0] != b[0] and None not in (*a[1:3], *b[1:3]) and all(map(math.isfinite, (*a[1:3], *b[1:3]))) and math.sqrt((a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2])) <= r}


@pytest.mark.parametrize("scale", [30.0, 400.0])
def test_near_pairs_brute_force(spark, scale):
    random.seed(int(scale))
    pts = [(i, random.uniform(-scale, scale), random.uniform(-scale, scale), "c") for i in range(300)]
    pts += [(1000, 0.0, 0.0, "c"), (1001, 5.0, 0.0, "c"), (1002, -3.0, -4.0, "c"), (1003, None, 1.0, "c"), (1004, float("nan"), 1.0, "c"), (1005, float("inf"), 1.0, "c"), (1006, 15.0, 15.0, "c"), (1007, 15.0, 15.0, "c"), (1008, 1e300, 0.0, "c"), (1009, 1e300, 0.0, "c")]
    df = spark.createDataFrame(pts, "id long, x double, y double, cell string").repartition(3)
    got = [tuple(r) for r in near_pairs(df, "id", "x", "y", 5.0).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(pts, 5.0)


def test_near_pairs_empty_and_repeated(spark):
    assert near_pairs(spark.createDataFrame([], "id long, x double, y double"), "id", "x", "y", 5.0).count() == 0
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0)], "id long, x double, y double")
    assert near_pairs(df, "id", "x", "y", 5.0).count() == 0


def test_ear_clip_covers_the_ring():
    star = [(math.cos(k * math.pi / 7) * (2 if k % 2 else 5), math.sin(k * math.pi / 7) * (2 if k % 2 else 5)) for k in range(14)]
    area = lambda p: abs(sum(p[i - 1][0] * p[i][1] - p[i][0] * p[i - 1][1] for i in range(len(p)))) / 2
    for ring in (star, star[::-1], [*star, star[0]], [(0, 0), (4, 0), (4, 4), (2, 4), (2, 2), (0, 2)], [(0, 0), (2, 0), (4, 0), (4, 4), (0, 4)]):
        tris = R.ear_clip(ring)
        assert abs(sum(map(area, tris)) - area(ring)) < 1e-9
    assert R.ear_clip([(0, 0), (1, 1)]) == [] and R.ear_clip([(0, 0), (0, 0), (0, 0)]) == []
    assert R._crosses([(0, 0), (2, 2), (2, 0), (0, 2)]) and not R._crosses(star)


def inside(x, y, ring):
    p = ring[:-1] if ring[0] == ring[-1] else ring
    odd = False
    for i in range(len(p)):
        (ax, ay), (bx, by) = p[i - 1], p[i]
        t = (ax - x) * (by - y) - (bx - x) * (ay - y)
        if t == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and (t > 0) == (by > ay):
            odd = not odd
    return odd


@pytest.mark.parametrize("bound", [10 << 20, -1])
def test_containing_regions_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(session, "BROADCAST_BYTES", bound)
    random.seed(8)
    rings = []
    for _ in range(60):
        cx, cy, n = random.randrange(-40, 40), random.randrange(-40, 40), random.randrange(3, 9)
        ring = [(cx + round(math.cos(2 * math.pi * k / n) * random.randrange(2, 9)), cy + round(math.sin(2 * math.pi * k / n) * random.randrange(2, 9))) for k in range(n)]
        rings.append(ring if random.random() < 0.5 else [*ring, ring[0]])
    rings += [[(0, 0), (8, 8), (8, 0), (0, 8)], [(0, 0), (4, 0), (4, 4), (2, 4), (2, 2), (0, 2)][::-1]]
    simple = [r for r in rings if R._crosses(r) or R.ear_clip(r) is not None]
    rows = [(k, [{"x": float(x), "y": float(y)} for x, y in r], "z") for k, r in enumerate(simple)] + [(900, None, "z"), (901, [], "z"), (902, [{"x": 0.0, "y": None}] * 3, "z")]
    pts = [(k, float(random.randrange(-50, 50)), float(random.randrange(-50, 50)), "p") for k in range(400)] + [(990, None, 1.0, "p"), (991, float("nan"), 1.0, "p")]
    z = spark.createDataFrame(rows, "fid long, ring array<struct<x:double,y:double>>, at string")
    p = spark.createDataFrame(pts, "fid long, x double, y double, at string")
    got = [tuple(r) for r in R.containing_regions(p, "fid", "x", "y", z, "fid", "ring").collect()]
    area = lambda r: sum(r[i - 1][0] * r[i][1] - r[i][0] * r[i - 1][1] for i in range(len(r)))
    want = {(a[0], k) for a in pts[:400] for k, r in enumerate(simple) if len({*r}) >= 3 and (area(r) != 0 or R._crosses(r)) and inside(a[1], a[2], r)}
    flat = {k for k, r in enumerate(simple) if area(r) == 0 and not R._crosses(r)}
    assert len(got) == len(set(got)) and {g for g in got if g[1] not in flat} == want


def test_containing_regions_empty(spark):
    z = spark.createDataFrame([], "fid long, ring array<struct<x:double,y:double>>")
    p = spark.createDataFrame([(1, 0.0, 0.0)], "fid long, x double, y double")
    assert R.containing_regions(p, "fid", "x", "y", z, "fid", "ring").count() == 0
