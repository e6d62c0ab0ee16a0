"""Geometry as column expressions: points are array<struct<x double, y double>>, coordinates doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radii of the two distance conventions, and metres of a degree used for tolerances (fixed values).
RADIUS_CONVERSION, RADIUS_EVALUATION, METRES_PER_DEGREE = 6_371_000.0, 6_371_008.8, 111_320.0
#: Half the side of the web-mercator square, and the radius it is built on (fixed values).
MERCATOR_MAX, MERCATOR_RADIUS = 20_037_508.342789244, 6_378_137.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


# --- text forms -----------------------------------------------------------------------------------------------------


def fixed(c: Column, decimals: int) -> Column:
    """The number with so many decimals, of the double's exact value: whole and broken part are written apart, as a
    formatter starts from the shortest decimal that gives the double.
    """
    c = c.cast("double")
    whole = F.floor(F.abs(c))
    part = F.format_string(f"%.{decimals}f", F.abs(c) - whole)
    digits = F.concat(F.when(c < 0, "-").otherwise(""), (whole + F.substring(part, 1, 1).cast("bigint")).cast("string"), F.substr(part, F.lit(2)))
    return F.when(F.abs(c) < 1e15, digits).otherwise(F.format_string(f"%.{decimals}f", c))


def _xy(p: Column, decimals: int) -> Column:
    return F.concat(fixed(p["x"], decimals), F.lit(" "), fixed(p["y"], decimals))


def wkt_point(x: Column, y: Column, decimals: int = 12) -> Column:
    return F.concat(F.lit("POINT ("), _xy(point(x, y), decimals), F.lit(")"))


def wkt_linestring(points: Column, decimals: int = 12) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: _xy(p, decimals)), ", "), F.lit(")"))


def wkt_polygon(points: Column, decimals: int = 12) -> Column:
    """Exterior ring only, closed if it isn't."""
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(closed(points), lambda p: _xy(p, decimals)), ", "), F.lit("))"))


def wkt_type(wkt: Column) -> Column:
    """Type name of a WKT text, upper case, an optional EWKT prefix skipped; NULL for anything else."""
    return F.nullif(F.upper(F.regexp_extract(wkt, r"^\s*(?:SRID=\d+;)?\s*([A-Za-z]+)", 1)), F.lit(""))


# --- shapes ---------------------------------------------------------------------------------------------------------


def _arc(cx: Column, cy: Column, r: Column, start: Column, span: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n), lambda j: point(cx + r * F.cos(start + span * j / n), cy + r * F.sin(start + span * j / n)))


def circle_points(cx: Column, cy: Column, r: Column, chord_tol: Column) -> Column:
    """n + 1 points, n = circumference / chord_tol within 12 and 360."""
    n = F.greatest(F.lit(12), F.least(F.lit(360), F.ceil(2 * math.pi * r / chord_tol))).cast("int")
    return _arc(cx, cy, r, F.lit(0.0), F.lit(2 * math.pi), n)


def arc_points(cx: Column, cy: Column, r: Column, start: Column, end: Column, chord_tol: Column) -> Column:
    """Counter-clockwise from start to end (radians), at least 10 parts."""
    span = F.when(end < start, end - start + 2 * math.pi).otherwise(end - start)
    n = F.greatest(F.lit(10), F.ceil(r * span / chord_tol)).cast("int")
    return _arc(cx, cy, r, start, span, n)


def arc_points_fixed(cx: Column, cy: Column, r: Column, start: Column, end: Column) -> Column:
    """The other convention: parts by angle, 36 for a full turn, at least 10."""
    span = F.when(end < start, end - start + 2 * math.pi).otherwise(end - start)
    n = F.greatest(F.lit(10), F.floor(36 * span / (2 * math.pi))).cast("int")
    return _arc(cx, cy, r, start, span, n)


def adaptive_chord_tolerance(extent: Column, geographic: bool = False) -> Column:
    """A thousandth of the extent, within 1e-6 and 0.01 degrees or 0.01 and 1000 metres."""
    lo, hi = (1e-6, 0.01) if geographic else (0.01, 1000.0)
    return F.greatest(F.lit(lo), F.least(F.lit(hi), extent * 0.001))


def closed(points: Column) -> Column:
    return F.when((F.size(points) > 0) & (F.element_at(points, 1) != F.element_at(points, -1)), F.concat(points, F.slice(points, 1, 1))).otherwise(points)


def reshape(points: Column, target: Column, is_closed: Column, centre: Column) -> Column:
    """Points in the form a layer asks for: Point the centre, LineString two points or more, Polygon three and closed; else NULL."""
    ring = F.when(F.size(points) >= 3, closed(points))
    return F.when(target == "Point", F.array(centre)).when((target == "LineString") & (F.size(points) >= 2), points).when((target == "Polygon") & is_closed, ring).when(target == "Polygon", ring)


# --- measures -------------------------------------------------------------------------------------------------------


def _pairs(points: Column) -> Column:
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = RADIUS_CONVERSION) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def line_length(points: Column, geographic: bool = False, radius: float = RADIUS_CONVERSION) -> Column:
    step = (lambda s: haversine(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], radius)) if geographic else (lambda s: distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))
    return F.when(F.size(points) < 2, 0.0).otherwise(_total(F.transform(_pairs(points), step)))


def centroid(points: Column) -> Column:
    """Mean of the vertices; (0, 0) of none."""
    n = F.size(points)
    mean = lambda k: F.when(n > 0, _total(F.transform(points, lambda p: p[k])) / n).otherwise(0.0)
    return point(mean("x"), mean("y"))


def bbox(points: Column) -> Column:
    ends = lambda k: (F.array_min(F.transform(points, lambda p: p[k])), F.array_max(F.transform(points, lambda p: p[k])))
    (x0, x1), (y0, y1) = ends("x"), ends("y")
    return F.struct(x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax"))


def area(points: Column) -> Column:
    """Shoelace; rings of fewer than three points have none."""
    cross = F.transform(_pairs(closed(points)), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])
    return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(_total(cross)) / 2)


def aspect_ratio(points: Column) -> Column:
    """Longer by shorter side of the box; infinite with one side under 1e-12, 1 with both and for fewer than three points."""
    b = bbox(points)
    w, h = b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]
    longer, shorter = F.greatest(w, h), F.least(w, h)
    return F.when((F.size(points) < 3) | (longer < 1e-12), 1.0).when(shorter < 1e-12, float("inf")).otherwise(longer / shorter)


def hausdorff(a: Column, b: Column) -> Column:
    """Discrete, over the vertices."""
    one = lambda p, q: F.array_max(F.transform(p, lambda u: F.array_min(F.transform(q, lambda v: distance(u["x"], u["y"], v["x"], v["y"])))))
    return F.greatest(one(a, b), one(b, a))


def span_suspicious(points: Column, limit: float = 1.0) -> Column:
    b = bbox(points)
    return (b["xmax"] - b["xmin"] > limit) | (b["ymax"] - b["ymin"] > limit)


def frame_artifact(points: Column, wide: float = 50.0, at_origin: float = 10.0) -> Column:
    """A frame rather than an object: wider than `wide`, or touching the origin and wider than `at_origin`."""
    b = bbox(points)
    span = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])
    return (span > wide) | (F.exists(points, lambda p: (F.abs(p["x"]) < 1e-9) & (F.abs(p["y"]) < 1e-9)) & (span > at_origin))


def closure_gap(points: Column) -> Column:
    a, z = F.element_at(points, 1), F.element_at(points, -1)
    return distance(a["x"], a["y"], z["x"], z["y"])


def repair_closure(points: Column, tol: float) -> Column:
    """Ring of three points or more whose ends lie apart by no more than tol (and not at all if equal), closed."""
    gap = closure_gap(points)
    return F.when((F.size(points) >= 3) & (gap > 0) & (gap <= tol), F.concat(points, F.slice(points, 1, 1))).otherwise(points)


def is_sliver(points: Column, min_area: float = 0.1, max_aspect: float = 100.0) -> Column:
    return (area(points) < min_area) & (aspect_ratio(points) > max_aspect)


# --- containment ----------------------------------------------------------------------------------------------------


def _turn(s: Column, x: Column, y: Column) -> Column:
    return (s["a"]["x"] - x) * (s["b"]["y"] - y) - (s["b"]["x"] - x) * (s["a"]["y"] - y)


def on_border(x: Column, y: Column, ring: Column) -> Column:
    within = lambda s, k, v: (F.least(s["a"][k], s["b"][k]) <= v) & (v <= F.greatest(s["a"][k], s["b"][k]))
    return F.exists(_pairs(closed(ring)), lambda s: (_turn(s, x, y) == 0) & within(s, "x", x) & within(s, "y", y))


def contains(x: Column, y: Column, ring: Column) -> Column:
    """Strictly inside: points on the border are not contained."""
    crossing = lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & ((_turn(s, x, y) > 0) == (s["b"]["y"] > s["a"]["y"]))
    return ~on_border(x, y, ring) & (F.size(F.filter(_pairs(closed(ring)), crossing)) % 2 == 1)


def segment_distance(px: Column, py: Column, s: Column) -> Column:
    """From a point to the segment s.a - s.b."""
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    norm = dx * dx + dy * dy
    t = F.when(norm == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - s["a"]["x"]) * dx + (py - s["a"]["y"]) * dy) / F.when(norm == 0, 1.0).otherwise(norm))))
    return distance(px, py, s["a"]["x"] + t * dx, s["a"]["y"] + t * dy)


def point_line_distance(px: Column, py: Column, points: Column) -> Column:
    one = F.transform(points, lambda p: distance(px, py, p["x"], p["y"]))
    return F.when(F.size(points) < 2, F.array_min(one)).otherwise(F.array_min(F.transform(_pairs(points), lambda s: segment_distance(px, py, s))))


def _cross(p: Column, q: Column) -> Column:
    a, b = _turn(p, q["a"]["x"], q["a"]["y"]), _turn(p, q["b"]["x"], q["b"]["y"])
    c, d = _turn(q, p["a"]["x"], p["a"]["y"]), _turn(q, p["b"]["x"], p["b"]["y"])
    return (a * b < 0) & (c * d < 0)


def lines_distance(a: Column, b: Column) -> Column:
    """0 where two segments cross, else the least distance of a vertex to the other line."""
    one = lambda p, q: F.array_min(F.transform(p, lambda v: point_line_distance(v["x"], v["y"], q)))
    meet = F.exists(_pairs(a), lambda s: F.exists(_pairs(b), lambda t: _cross(s, t)))
    return F.when(meet, 0.0).otherwise(F.least(one(a, b), one(b, a)))


def overlaps(a: Column, b: Column) -> Column:
    """Interiors meet but neither ring holds the other: borders cross, or a vertex of each kind lies strictly inside and strictly outside.

    Containment and equality are no overlap.
    """
    meet = F.exists(_pairs(closed(a)), lambda s: F.exists(_pairs(closed(b)), lambda t: _cross(s, t)))
    inside = lambda p, q: F.exists(p, lambda v: contains(v["x"], v["y"], q))
    outside = lambda p, q: F.exists(p, lambda v: ~contains(v["x"], v["y"], q) & ~on_border(v["x"], v["y"], q))
    return meet | (inside(a, b) & outside(a, b)) | (inside(b, a) & outside(b, a))


# --- directions and positions along lines -----------------------------------------------------------------------------


def end_direction(points: Column, at_start: bool) -> Column:
    """Unit vector that leaves the line at one of its ends; (0, 0) of a line without length there."""
    a, b = (F.element_at(points, 2), F.element_at(points, 1)) if at_start else (F.element_at(points, -2), F.element_at(points, -1))
    n = distance(a["x"], a["y"], b["x"], b["y"])
    part = lambda k: F.when(n > 0, (b[k] - a[k]) / F.when(n > 0, n).otherwise(1.0)).otherwise(0.0)
    return point(part("x"), part("y"))


def goes_on(d1: Column, d2: Column, min_cos: float = math.cos(math.radians(30))) -> Column:
    """Whether the line leaving along d2 continues the one leaving along d1 (they face each other)."""
    return -(d1["x"] * d2["x"] + d1["y"] * d2["y"]) >= min_cos


def chainage(points: Column) -> Column:
    """Length up to each vertex, 0 first."""
    steps = F.transform(_pairs(points), lambda s: distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))
    return F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d)))


# --- coordinate systems -----------------------------------------------------------------------------------------------


def mercator_to_wgs84(x: Column, y: Column) -> Column:
    return point(F.degrees(x / MERCATOR_RADIUS), F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS)) - math.pi / 2))


def wgs84_to_mercator(lon: Column, lat: Column) -> Column:
    return point(F.radians(lon) * MERCATOR_RADIUS, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * MERCATOR_RADIUS)


def utm_to_wgs84(easting: Column, northing: Column, zone: int, north: bool = True) -> Column:
    """Inverse transverse Mercator by Krueger's series to the third order (WGS84)."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6_378_137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = (northing - (0.0 if north else 10_000_000.0)) / (0.9996 * a)
    eta = (easting - 500_000.0) / (0.9996 * a)
    xi_, eta_ = xi, eta
    for j, b in enumerate(beta, 1):
        xi_ = xi_ - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_ = eta_ - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi_) / F.cosh(eta_))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return point(F.lit(zone * 6.0 - 183.0) + F.degrees(F.atan2(F.sinh(eta_), F.cos(xi_))), F.degrees(lat))


def regime_to_mercator(x: Column, y: Column, dx: float, dy: float, zone: int = 48) -> Column:
    """Drawing coordinates of a regime, moved by its offset into UTM, as web-mercator."""
    g = utm_to_wgs84(x + dx, y + dy, zone)
    return wgs84_to_mercator(g["x"], g["y"])


def reproject(p: Column, source: int, target: int) -> Column:
    """Between EPSG 3857 and 4326 and from UTM (326xx, 327xx); the same code gives the point itself."""
    if source == target:
        return p
    utm = source // 100 in (326, 327)
    if not (utm or {source, target} == {3857, 4326}) or target not in (3857, 4326):
        raise ValueError(f"no transformation from EPSG:{source} to EPSG:{target}")
    g = utm_to_wgs84(p["x"], p["y"], source % 100, source // 100 == 326) if utm else mercator_to_wgs84(p["x"], p["y"]) if source == 3857 else p
    return wgs84_to_mercator(g["x"], g["y"]) if target == 3857 else g


def reproject_all(points: Column, source: int, target: int) -> Column:
    return F.transform(points, lambda p: reproject(p, source, target))


def valid_coordinate(x: Column, y: Column, epsg: int) -> Column:
    """Within the range of the coordinate system's class."""
    lx, ly = (180.0, 90.0) if epsg == 4326 else (MERCATOR_MAX, MERCATOR_MAX) if epsg == 3857 else (1e8, 1e8)
    return (F.abs(x) <= lx) & (F.abs(y) <= ly)


def in_region(x: Column, y: Column, epsg: int, bounds: tuple[float, float, float, float]) -> Column:
    """Flag only: whether a point lies in (lat_min, lat_max, lon_min, lon_max)."""
    g = reproject(point(x, y), epsg, 4326)
    return g["y"].between(bounds[0], bounds[1]) & g["x"].between(bounds[2], bounds[3])


def metres_to_units(metres: float, geographic: bool) -> float:
    return metres / METRES_PER_DEGREE if geographic else metres


def metric_scale(epsg: int, y0: Column, y1: Column) -> Column:
    """Metres of a unit in x and y at the middle latitude of an extent."""
    mid = (y0 + y1) / 2
    per_degree = math.pi * MERCATOR_RADIUS / 180
    if epsg == 4326:
        return point(per_degree * F.cos(F.radians(mid)), F.lit(per_degree))
    if epsg == 3857:
        c = F.cos(2 * F.atan(F.exp(mid / MERCATOR_RADIUS)) - math.pi / 2)
        return point(c, c)
    return point(F.lit(1.0), F.lit(1.0))


def parse_epsg(label: str | None) -> int | None:
    """EPSG number of a label; None for an empty one, `any` and `none`, which disable a check."""
    text = (label or "").strip().upper().removeprefix("EPSG:")
    return int(text) if text.isdigit() else None
