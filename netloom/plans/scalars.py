"""Queries of the scalar library: geometry, colours, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import colour as C
from netloom.functions import geo as G
from netloom.functions import text as T
from netloom.functions.keys import ref_key
from netloom.plans import views as V
from netloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_V = f"WITH {V.SQL_VIEWS}"
_PTS = _V + ", l AS (SELECT id, list({'x': x, 'y': y} ORDER BY k) p, count(*) n FROM pt GROUP BY id)"


@query(_V + " SELECT id, printf('POINT (%.12f %.12f)', x, y) wkt, 'POINT' kind FROM node")
def wkt_points(spark: SparkSession, d: str) -> DataFrame:
    w = G.wkt_point(F.col("x"), F.col("y"))
    return V.node(spark, d).select("id", w.alias("wkt"), G.wkt_type(w).alias("kind"))


@query(_V + " SELECT id, 'POLYGON ((' || printf('%.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f', x0, y0, x0 + side, y0, x0 + side, y0 + side, x0, y0 + side, x0, y0) || '))' polygon, 'LINESTRING (' || printf('%.6f %.6f, %.6f %.6f', x0, y0, x0 + side, y0) || ')' line FROM zones")
def wkt_shapes(spark: SparkSession, d: str) -> DataFrame:
    return V.zone(spark, d).select("id", G.wkt_polygon(F.slice("ring", 1, 4), 6).alias("polygon"), G.wkt_linestring(F.slice("ring", 1, 2), 6).alias("line"))


@query("WITH r AS (SELECT p_partkey id, p_size / 3.0 r, greatest(12, least(360, CAST(ceil(2 * pi() * (p_size / 3.0) / 0.5) AS INTEGER))) n FROM part), e AS (SELECT id, r, n, unnest(range(0, n + 1)) j FROM r) SELECT id, CAST(n + 1 AS INTEGER) n_points, round(sum(10 + r * cos(2 * pi() * j / n)), 4) sum_x FROM e GROUP BY id, n")
def circle_points(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), G.circle_points(F.lit(10.0), F.lit(5.0), F.col("p_size") / 3.0, F.lit(0.5)).alias("p"))
    return p.select("id", F.size("p").alias("n_points"), F.round(F.aggregate("p", F.lit(0.0), lambda s, v: s + v["x"]), 4).alias("sum_x"))


@query("WITH r AS (SELECT p_partkey id, CAST(p_size AS DOUBLE) r, CASE WHEN p_partkey % 2 = 0 THEN pi() / 2 ELSE 2 * pi() - 1 + 0.5 END span FROM part), s AS (SELECT *, greatest(10, CAST(ceil(r * span / 2.0) AS INTEGER)) n FROM r) SELECT id, CAST(n + 1 AS INTEGER) n_points, round(n * 2 * r * sin(span / n / 2), 4) len FROM s")
def arc_points(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("p_partkey") % 2 == 0
    start, end = F.when(even, 0.0).otherwise(1.0), F.when(even, 1.5707963267948966).otherwise(0.5)
    a = table(spark, d, "part").select(F.col("p_partkey").alias("id"), G.arc_points(F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double"), start, end, F.lit(2.0)).alias("p"))
    return a.select("id", F.size("p").alias("n_points"), F.round(G.line_length(F.col("p")), 4).alias("len"))


@query(_V + ", s AS (SELECT id, x, y, lead(x) OVER w nx, lead(y) OVER w ny FROM pt WINDOW w AS (PARTITION BY id ORDER BY k)) SELECT id, round(coalesce(sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))), 0), 4) len FROM s GROUP BY id")
def line_length(spark: SparkSession, d: str) -> DataFrame:
    return V.line(spark, d).select("id", F.round(G.line_length(F.col("points")), 4).alias("len"))


@query(_V + " SELECT id, round(avg(x), 6) cx, round(avg(y), 6) cy, min(x) xmin, min(y) ymin, max(x) xmax, max(y) ymax FROM pt GROUP BY id")
def centroid_bbox(spark: SparkSession, d: str) -> DataFrame:
    ln = V.line(spark, d).select("id", G.centroid(F.col("points")).alias("c"), G.bbox(F.col("points")).alias("b"))
    return ln.select("id", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"), "b.xmin", "b.ymin", "b.xmax", "b.ymax")


@query("SELECT fid, round(abs(sum(px * qy - qx * py)) / 2, 2) area FROM (SELECT fid, s.p.x - 11400000 px, s.p.y py, s.q.x - 11400000 qx, s.q.y qy FROM (SELECT fid, unnest(list_transform(range(1, len(ring) + 1), lambda i: {'p': ring[i], 'q': ring[i % len(ring) + 1]})) s FROM zpm WHERE ring IS NOT NULL)) GROUP BY fid")
def shoelace(spark: SparkSession, d: str) -> DataFrame:
    z = table(spark, d, "zpm").where("ring IS NOT NULL").select("fid", F.transform("ring", lambda p: F.struct((p["x"] - 11_400_000).alias("x"), p["y"].alias("y"))).alias("ring"))
    return z.select("fid", F.round(G.area(F.col("ring")), 2).alias("area"))


@query(_V + ", b AS (SELECT id, count(*) n, max(x) - min(x) w, max(y) - min(y) h FROM pt GROUP BY id), s AS (SELECT id, x, y, coalesce(lead(x) OVER v, first_value(x) OVER v) nx, coalesce(lead(y) OVER v, first_value(y) OVER v) ny FROM pt WINDOW v AS (PARTITION BY id ORDER BY k)), a AS (SELECT id, abs(sum(x * ny - nx * y)) / 2 area FROM s GROUP BY id), r AS (SELECT id, n, CASE WHEN n < 3 OR greatest(w, h) < 1e-12 THEN 1 WHEN least(w, h) < 1e-12 THEN 1e9 ELSE greatest(w, h) / least(w, h) END ratio FROM b) SELECT id, round(ratio, 6) ratio, CASE WHEN n < 3 THEN 0 ELSE area END < 100000 AND ratio > 1.3 sliver FROM r JOIN a USING (id)")
def aspect_ratio(spark: SparkSession, d: str) -> DataFrame:
    r = G.aspect_ratio(F.col("points"))
    return V.line(spark, d).select("id", F.round(F.when(r == float("inf"), 1e9).otherwise(r), 6).alias("ratio"), G.is_sliver(F.col("points"), 100_000.0, 1.3).alias("sliver"))


@query(_V + ", z AS (SELECT id, unnest([{'x': x0, 'y': y0}, {'x': x0 + side, 'y': y0}, {'x': x0 + side, 'y': y0 + side}, {'x': x0, 'y': y0 + side}]) p FROM zones), m AS (SELECT a.id i, b.id j, a.p, min(sqrt((a.p.x - b.p.x) * (a.p.x - b.p.x) + (a.p.y - b.p.y) * (a.p.y - b.p.y))) m FROM z a JOIN z b ON a.id <> b.id GROUP BY 1, 2, 3), h AS (SELECT i, j, max(m) h FROM m GROUP BY 1, 2) SELECT a.i left_id, a.j right_id, round(greatest(a.h, b.h), 6) d FROM h a JOIN h b ON a.i = b.j AND a.j = b.i WHERE a.i + 1 = a.j")
def hausdorff(spark: SparkSession, d: str) -> DataFrame:
    z = V.zone(spark, d).select("id", F.slice("ring", 1, 4).alias("ring"))
    n = z.select((F.col("id") - 1).alias("id"), F.col("id").alias("right_id"), F.col("ring").alias("r2"))
    return z.join(n, "id").select(F.col("id").alias("left_id"), "right_id", F.round(G.hausdorff(F.col("ring"), F.col("r2")), 6).alias("d"))


@query("SELECT s_suppkey id, round(2 * 6371000.0 * asin(least(1, sqrt(pow(sin(radians(10) / 2), 2) + cos(radians(s_suppkey % 60)) * cos(radians(s_suppkey % 60 + 10)) * pow(sin(radians(5) / 2), 2)))), 3) d_conv, round(2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(10) / 2), 2) + cos(radians(s_suppkey % 60)) * cos(radians(s_suppkey % 60 + 10)) * pow(sin(radians(5) / 2), 2)))), 3) d_eval FROM supplier")
def haversine(spark: SparkSession, d: str) -> DataFrame:
    lat = F.col("s_suppkey") % 60
    one = lambda r: F.round(G.haversine(F.lit(100.0), lat, F.lit(105.0), lat + 10, r), 3)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), one(G.RADIUS_CONVERSION).alias("d_conv"), one(G.RADIUS_EVALUATION).alias("d_eval"))


@query("WITH p AS (SELECT fid, x, greatest(least(y, 1e8), -1e8) y FROM boite WHERE x IS NOT NULL AND y IS NOT NULL) SELECT fid, round(degrees(x / 6378137.0), 7) lon, round(degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2), 7) lat, abs(x) <= 20037508.342789244 AND abs(y) <= 20037508.342789244 valid, degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2) BETWEEN -1 AND 1 AND degrees(x / 6378137.0) BETWEEN 102 AND 103 in_region FROM p")
def mercator(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "boite").where("x IS NOT NULL AND y IS NOT NULL").withColumn("y", F.greatest(F.least("y", F.lit(1e8)), F.lit(-1e8)))
    g = G.reproject(G.point(F.col("x"), F.col("y")), 3857, 4326)
    return b.select("fid", F.round(g["x"], 7).alias("lon"), F.round(g["y"], 7).alias("lat"), G.valid_coordinate(F.col("x"), F.col("y"), 3857).alias("valid"), G.in_region(F.col("x"), F.col("y"), 3857, (-1.0, 1.0, 102.0, 103.0)).alias("in_region"))


_N = "0.0016792203863837047"


@query(_V + f""", c AS (SELECT id, x % 1000 + 500000.0 e, y % 1000 - 405.0 n, 6378137.0 / (1 + {_N}) * (1 + pow({_N}, 2) / 4 + pow({_N}, 4) / 64) * 0.9996 a FROM node),
k AS (SELECT id, n / a xi, (e - 500000.0) / a eta, {_N} / 2 - 2 * pow({_N}, 2) / 3 + 37 * pow({_N}, 3) / 96 - pow({_N}, 4) / 360 b1, pow({_N}, 2) / 48 + pow({_N}, 3) / 15 - 437 * pow({_N}, 4) / 1440 b2, 17 * pow({_N}, 3) / 480 - 37 * pow({_N}, 4) / 840 b3 FROM c),
h AS (SELECT *, (exp(2 * eta) + exp(-2 * eta)) / 2 c2, (exp(2 * eta) - exp(-2 * eta)) / 2 s2, (exp(4 * eta) + exp(-4 * eta)) / 2 c4, (exp(4 * eta) - exp(-4 * eta)) / 2 s4, (exp(6 * eta) + exp(-6 * eta)) / 2 c6, (exp(6 * eta) - exp(-6 * eta)) / 2 s6 FROM k),
p AS (SELECT id, xi - b1 * sin(2 * xi) * c2 - b2 * sin(4 * xi) * c4 - b3 * sin(6 * xi) * c6 u, eta - b1 * cos(2 * xi) * s2 - b2 * cos(4 * xi) * s4 - b3 * cos(6 * xi) * s6 v FROM h),
q AS (SELECT id, asin(sin(u) / ((exp(v) + exp(-v)) / 2)) chi, radians(105) + atan(((exp(v) - exp(-v)) / 2) / cos(u)) lam FROM p),
l AS (SELECT id, lam, chi + (2 * {_N} - 2 * pow({_N}, 2) / 3 - 2 * pow({_N}, 3)) * sin(2 * chi) + (7 * pow({_N}, 2) / 3 - 8 * pow({_N}, 3) / 5) * sin(4 * chi) + 56 * pow({_N}, 3) / 15 * sin(6 * chi) phi FROM q)
SELECT id, round(lam * 6378137.0, 2) x, round(ln(tan(pi() / 4 + phi / 2)) * 6378137.0, 2) y FROM l""")
def utm_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Drawing coordinates of regime A moved into UTM 48N and on to web-mercator."""
    m = G.regime_to_mercator(500_000.0 - 292_539 + F.col("x") % 1000, F.col("y") % 1000, 292_539.0, -405.0)
    return V.node(spark, d).select("id", F.round(m["x"], 2).alias("x"), F.round(m["y"], 2).alias("y"))


@query(_V + ", s AS (SELECT id, x, y, nullif(upper(trim(\"ref\", chr(32) || chr(9))), '') r FROM csite), e AS (SELECT *, nullif(upper(trim(code, chr(32) || chr(9))), '') k FROM sides) SELECT s.id, e.id zone FROM s JOIN e ON e.k = s.r GROUP BY 1, 2 HAVING sum(CASE WHEN (py > y) <> (qy > y) AND ((px - x) * (qy - y) - (py - y) * (qx - x) > 0) = (qy > py) THEN 1 ELSE 0 END) % 2 = 1 AND NOT bool_or((px - x) * (qy - y) - (py - y) * (qx - x) = 0 AND least(px, qx) <= x AND greatest(px, qx) >= x AND least(py, qy) <= y AND greatest(py, qy) >= y)")
def pip_zone(spark: SparkSession, d: str) -> DataFrame:
    """Branching boxes inside the zones they name."""
    s, z = V.site(spark, d).withColumn("k", ref_key("ref")), V.area(spark, d).select(F.col("id").alias("zone"), "ring", ref_key("code").alias("k"))
    return s.join(z, "k").where(G.contains(F.col("x"), F.col("y"), F.col("ring"))).select("id", "zone")


@query(_V + " SELECT id, round(area, 4) area, (area < 45000) small, round(least(1000, greatest(0.01, side * 0.001)), 6) chord FROM (SELECT id, side, side * side area FROM zones)")
def zone_measures(spark: SparkSession, d: str) -> DataFrame:
    z = V.zone(spark, d)
    return z.select("id", F.round(G.area(F.col("ring")), 4).alias("area"), G.is_sliver(F.col("ring"), 45_000, 0.5).alias("small"), F.round(G.adaptive_chord_tolerance(F.col("side")), 6).alias("chord"))


@query(_V + ", s AS (SELECT id, x, y, nullif(upper(trim(\"ref\", chr(32) || chr(9))), '') r FROM csite), a AS (SELECT s.id, z.id zone, ring[1].x - x ax, ring[1].y - y ay, ring[2].x - ring[1].x dx, ring[2].y - ring[1].y dy FROM s JOIN areas z ON nullif(upper(trim(z.code, chr(32) || chr(9))), '') = s.r), t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) END t FROM a) SELECT id, zone, round(sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)), 4) d FROM t")
def line_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance of the branching boxes to the first side of the zones they name."""
    s, z = V.site(spark, d).withColumn("k", ref_key("ref")), V.area(spark, d).select(F.col("id").alias("zone"), F.slice("ring", 1, 2).alias("side"), ref_key("code").alias("k"))
    return s.join(z, "k").select("id", "zone", F.round(G.point_line_distance(F.col("x"), F.col("y"), F.col("side")), 4).alias("d"))


@query(_PTS + " SELECT id, CAST(CASE WHEN n >= 3 AND p[1] <> p[-1] THEN n + 1 ELSE n END AS INTEGER) n_closed, n >= 3 is_ring FROM l")
def ring_closure(spark: SparkSession, d: str) -> DataFrame:
    ln = V.line(spark, d).select("id", F.size("points").alias("n"), F.size(G.repair_closure(F.col("points"), 1e9)).alias("n_closed"))
    return ln.select("id", "n_closed", (F.col("n") >= 3).alias("is_ring"))


@query(_V + ", s AS (SELECT id, k, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) step FROM pt WINDOW w AS (PARTITION BY id ORDER BY k)) SELECT id, CAST(k AS INTEGER) k, round(coalesce(sum(step) OVER (PARTITION BY id ORDER BY k), 0), 3) chainage FROM s")
def chainage(spark: SparkSession, d: str) -> DataFrame:
    c = V.line(spark, d).select("id", F.posexplode(G.chainage(F.col("points"))).alias("k", "c"))
    return c.select("id", (F.col("k") + 1).alias("k"), F.round("c", 3).alias("chainage"))


@query("WITH pal AS (SELECT * FROM (VALUES (1, '#FF0000'), (2, '#FFFF00'), (3, '#00FF00'), (4, '#00FFFF'), (5, '#0000FF'), (6, '#FF00FF'), (7, '#000000'), (8, '#414141'), (9, '#808080'), (10, '#FF0000'), (11, '#FF7F7F'), (30, '#FF7F00'), (90, '#00FF00'), (170, '#0000FF'), (250, '#333333'), (251, '#5B5B5B'), (252, '#848484'), (253, '#ADADAD'), (254, '#D6D6D6'), (255, '#FFFFFF')) v(aci, rgb)), e AS (SELECT p_partkey id, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 30, 90, 170, 250, 251, 252, 253, 254, 255, 256, 257, 300][p_partkey * 7 % 24 + 1] aci, CASE WHEN p_partkey % 5 = 0 THEN p_partkey * 65537 % 16777216 END tc, CASE WHEN p_size % 2 = 0 THEN 'Dashed' END lt, [1, 2, 8, 9, 250, 254, 260][p_size % 7 + 1] laci FROM part), f AS (SELECT id, CASE WHEN tc IS NULL AND aci IN (0, 256) THEN laci ELSE aci END a, tc, lt FROM e), g AS (SELECT id, CASE WHEN tc IS NULL AND NOT (a BETWEEN 1 AND 255) THEN 7 ELSE a END color_aci, tc, lt FROM f) SELECT id, CAST(color_aci AS INTEGER) color_aci, CASE WHEN tc IS NOT NULL THEN '#' || lpad(printf('%X', tc), 6, '0') ELSE rgb END color_rgb, CASE WHEN tc IS NOT NULL THEN '#' || lpad(printf('%X', tc), 6, '0') ELSE rgb END || '|' || coalesce(lt, 'Continuous') style_key FROM g LEFT JOIN pal ON pal.aci = g.color_aci")
def effective_colour(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    pick = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    own, by_layer = pick([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 30, 90, 170, 250, 251, 252, 253, 254, 255, 256, 257, 300], p * 7 % 24), pick([1, 2, 8, 9, 250, 254, 260], F.col("p_size") % 7)
    e = C.effective(own, F.when(p % 5 == 0, p * 65537 % 16777216), F.when(F.col("p_size") % 2 == 0, "Dashed"), by_layer, F.lit(None).cast("bigint"), F.lit(None).cast("string"))
    return table(spark, d, "part").select(p.alias("id"), e.alias("e")).select("id", "e.color_aci", "e.color_rgb", "e.style_key")


@query("SELECT p_partkey id, CAST(CASE WHEN p_partkey % 3 = 1 THEN p_partkey % 256 ELSE 256 END AS INTEGER) aci, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 65536 END AS INTEGER) truecolor FROM part")
def packed_colour(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    raw = F.when(p % 3 == 0, F.lit(0xC2 << 24) + p % 65536).when(p % 3 == 1, F.lit(0xC3 << 24) + p % 256).otherwise(0)
    return table(spark, d, "part").select(p.alias("id"), C.unpack(raw, F.lit(256)).alias("c")).select("id", F.col("c.aci").cast("int").alias("aci"), "c.truecolor")


@query("SELECT p_partkey id, CASE WHEN p_size % 4 = 0 THEN 'dash dot' WHEN p_size % 4 = 1 THEN 'dot' WHEN p_size % 4 = 2 THEN 'dash' ELSE 'solid' END pen, CASE WHEN p_size % 2 = 0 THEN '18,52,86,255' ELSE '64,64,64,255' END rgba, '#ABCDEF' rgb FROM part")
def pen_styles(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size") % 4
    name = F.when(s == 0, "Center2").when(s == 1, "Dot").when(s == 2, "HIDDEN").otherwise("Continuous")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.pen(name).alias("pen"), C.rgba(F.when(F.col("p_size") % 2 == 0, "#123456").otherwise("red")).alias("rgba"), C.rgb_last_six(F.lit("FFabcdef")).alias("rgb"))


def _case(col: str, patterns: list[tuple], value: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p[0]}', 'i') THEN '{p[value]}'" for p in patterns) + " END"


_NEG = "'approval', 'approval matrix', 'legend', 'cartouche', 'title', 'title block', 'legende', 'defpoints', 'north arrow', 'scale bar', 'grid', 'base map', 'basic map', 'bom', 'outline', 'boeder', 'mainlayer', 'fenetres archicad', 'portes archicad', 'carlage', 'pompier', 'fenêtres', 'murs 2', 'design summary', '0'"
# what the patterns come to, written out for the check
_BY_LAYER = [
    ("fat\\s*area|boundary\\s*fat|hp\\s*cover|zpm|zone.*pm|zone.*sro|distribution.*zone|service.*zone", "ZPM"),
    ("fdt", "SITE"),
    ("\\bfat\\b|^nap|box|slimbox|blackbox|closure|cto|dp\\b|ont|pedestal|splice|splitter|spliter|patch|panel|terminal|otb|fsc|boite|hw-fat", "BOITE"),
    ("pole|poteau|chamber|chambre|manhole|handhole|anchor|guy\\b|vault|ptech|gaine\\s*technique|gc\\s|appui|ancrage|hw-handhole|iam\\s*mh", "PTECH"),
    ("home\\s*number|home\\s*pass|building|batiment|premise|house|unit|apartment|office|mdu|sdu|imb|property|address|customer|subscriber|logement|maison|villa|immeuble|residence", "IMB"),
    ("duct|conduit|pipe|trench|infra|pathway|route|buried|underground|aerial|fourreau|adduction|branchement|raccordement|gaine|new\\s*duct|pit|handhole|chamber", "INFRASTRUCTURE"),
    ("cable|fib[er]*e|feeder|trunk|distribution|drop|riser|lateral|backbone|access|span\\s*cable|micro\\s*cable|loose\\s*cable|sling\\s*wire|suspension\\s*wire|span\\s*sling|sling|fo\\s*[0-9]+\\s*core|fo\\s*cable|service\\s*core|expansion\\s*core|moniter\\s*core|monitor\\s*core|^line$", "CABLE"),
    ("site|nro|pm\\b|exchange|node|hub|pop\\b|co\\b|shelter|cabinet|location|olt|ftts|local.*tech", "SITE"),
    ("znro|zone.*nro|olt.*zone|exchange.*zone|coverage|service.*area", "ZNRO"),
    ("^eu$|^go[0-9]*$|^go$", "PTECH"),
    ("^pln$|^telkom$", "SITE"),
    ("ftts.*site", "SITE"),
    ("^text$|etik", "IMB"),
]
_BY_TEXT = [
    ("fibre|fiber|optic|box|closure|splice|cable|wire|drop", "CABLE"),
    ("chamber|manhole|handhole|pole|anchor|guy|trench|vault", "PTECH"),
    ("nro|pm|shelter|cabinet|exchange|node|hub|olt|splitter", "SITE"),
    ("duct|conduit|pipe|trench|infra|buried|aerial|underground", "INFRASTRUCTURE"),
    ("building|premise|house|home|unit|apartment|office|mdu|sdu", "IMB"),
    ("zone|area|boundary|coverage|region|polygon|district", "ZNRO"),
]


@query(f"WITH c AS (SELECT entity_id, CASE WHEN lower(trim(layer)) IN ({_NEG}) THEN 'fc_misc' ELSE {_case('layer', _BY_LAYER, 1)} END one, {_case('text', _BY_TEXT, 1)} two FROM intermediate_pipeline_dump) SELECT entity_id, coalesce(one, two, 'fc_misc') fc_name, CASE WHEN one = 'fc_misc' THEN 1.0::DOUBLE WHEN one IS NOT NULL THEN 0.9::DOUBLE WHEN two IS NOT NULL THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END confidence, CASE WHEN one = 'fc_misc' THEN 'negative_evidence' WHEN one IS NOT NULL THEN 'tier1_layer_pattern' WHEN two IS NOT NULL THEN 'tier2_annotation_keyword' ELSE 'unclassified' END AS method FROM c")
def classify(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "intermediate_pipeline_dump")
    tiers = e.select("entity_id", T.tier1(F.col("layer")).alias("one"), T.tier2(F.col("text")).alias("two"))
    return tiers.select("entity_id", T.assign_class(F.col("one"), F.col("two")).alias("c")).select("entity_id", "c.fc_name", "c.confidence", "c.method")


@query(_V.rstrip() + ", p AS (SELECT p_partkey id, p_type || ' ' || p_size || ' FO ' || (p_size % 7) || 'C 12 mm ' || CASE WHEN p_size % 3 = 0 THEN 'FDT planned feeder' WHEN p_size % 3 = 1 THEN 'NRO fat built' ELSE 'G657A2 aerial' END t, p_size s FROM part) SELECT id, CAST(s AS VARCHAR) fibres, CAST(s % 7 AS VARCHAR) capacity, '12' diameter, CASE WHEN s % 3 = 0 THEN 'FDT' WHEN s % 3 = 1 THEN 'NRO' END kind, CASE WHEN s % 3 = 0 THEN 'PROPOSED' WHEN s % 3 = 1 THEN 'BUILT' END status, CASE WHEN s % 3 = 0 THEN 'TRANSPORT' END cable, CASE WHEN s % 3 = 2 THEN 'G657A2' END fibre FROM p")
def extract_attributes(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    t = F.concat_ws(" ", F.lit("x"), s.cast("string"), F.lit("FO"), F.concat((s % 7).cast("string"), F.lit("C")), F.lit("12 mm"), F.when(s % 3 == 0, "FDT planned feeder").when(s % 3 == 1, "NRO fat built").otherwise("G657A2 aerial"))
    a = table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.attributes(t).alias("a"))
    get = lambda k, n: F.try_element_at("a", F.lit(k)).alias(n)
    return a.select("id", get("NB_FIBRE_UTIL", "fibres"), get("CAPACITE", "capacity"), get("DIAMETRE", "diameter"), get("TYPE", "kind"), get("STATUT", "status"), get("TYPE_CABLE", "cable"), get("TYPE_FIBRE", "fibre"))


@query("WITH f AS (SELECT p_partkey id, CASE p_partkey % 4 WHEN 0 THEN 'DMPH-' || p_size || '.1.A01' WHEN 1 THEN 'MR.DMPH.P' || p_size WHEN 2 THEN 'EXT.MR.A.B.C.P' || p_size ELSE 'x DMPH-1.1.A01' END t FROM part) SELECT id, CASE WHEN regexp_full_match(t, 'DMPH-\\d+\\.\\d+\\.[A-Z]\\d{2}') THEN 'fat' WHEN regexp_full_match(t, 'MR\\.DMPH\\.P\\d+') THEN 'pole' WHEN regexp_full_match(t, 'EXT\\.MR\\.\\w+\\.\\w+\\.\\w+\\.P\\d+') THEN 'pole_ext' END family, CASE id % 4 WHEN 0 THEN 'BOITE' WHEN 1 THEN 'PTECH' WHEN 2 THEN 'PTECH' END target FROM f")
def label_family(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    t = F.when(p == 0, F.concat(F.lit("DMPH-"), s, F.lit(".1.A01"))).when(p == 1, F.concat(F.lit("MR.DMPH.P"), s)).when(p == 2, F.concat(F.lit("EXT.MR.A.B.C.P"), s)).otherwise("x DMPH-1.1.A01")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.family(t).alias("family")).withColumn("target", T.family_target(F.col("family")))


_LAYOUTS = ["Model", "FDT-01 TOPOLOGY", "SPLICING 2", "Cable Type", "FDT LAYOUT", "FDT-ALL", "FDT 12", "plan A", "notes", ""]


@query("WITH n AS (SELECT DISTINCT trim(w || CASE WHEN w = 'Model' THEN '' ELSE ' ' || coalesce(layer, '') END) AS name FROM intermediate_pipeline_dump, (VALUES ('Model'), ('FDT-01 TOPOLOGY'), ('SPLICING 2'), ('Cable Type'), ('FDT LAYOUT'), ('FDT-ALL'), ('FDT 12'), ('plan A'), ('notes'), ('')) v(w)), r AS (SELECT name, CASE WHEN lower(name) = 'model' THEN 'model' WHEN regexp_matches(name, 'TOPOLOGY|SPLICING|SCHEMATIC|DIAGRAM', 'i') THEN 'topology' WHEN regexp_matches(name, 'LEGEND|CABLE[ _-]*TYPE|SYMBOL', 'i') THEN 'legend' WHEN regexp_matches(name, 'FDT[ _-]*LAYOUT|EQUIPMENT', 'i') THEN 'equipment' WHEN regexp_matches(name, '^(FDT[-_ ]?(ALL|[0-9]+)|PLAN|NETWORK)', 'i') THEN 'plan' ELSE 'other' END AS role FROM n) SELECT name, role, CASE WHEN role = 'model' THEN 'geometry_source' WHEN role = 'plan' THEN 'fdt_tagging' WHEN role = 'topology' AND NOT regexp_matches(name, 'SPLICING', 'i') THEN 'evidence' ELSE 'exclude' END disposition FROM r")
def layout_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles of sheet names made of the layers' names."""
    w = table(spark, d, "intermediate_pipeline_dump").select("layer").distinct().select("layer", F.explode(F.array(*[F.lit(x) for x in _LAYOUTS])).alias("w"))
    n = w.select(F.trim(F.concat("w", F.when(F.col("w") == "Model", "").otherwise(F.concat(F.lit(" "), F.coalesce("layer", F.lit("")))))).alias("name")).distinct()
    return n.select("name", T.layout_role(F.col("name")).alias("role"), T.layout_disposition(F.col("name")).alias("disposition"))


@query("SELECT DISTINCT source_dwg, upper(regexp_replace(trim(source_dwg), '\\s+', '-', 'g')) IS NOT NULL has_code, CASE WHEN regexp_matches(regexp_replace(source_dwg, '[^A-Za-z0-9_]', '_', 'g'), '^[0-9]') THEN 'L_' ELSE '' END || substr(regexp_replace(source_dwg, '[^A-Za-z0-9_]', '_', 'g'), 1, 50) safe FROM intermediate_pipeline_dump")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "intermediate_pipeline_dump").select("source_dwg").distinct().select("source_dwg", T.clean_code(F.col("source_dwg")).isNotNull().alias("has_code"), T.safe_layer_name(F.col("source_dwg")).alias("safe"))


@query("SELECT fid, nullif(substr(regexp_replace(regexp_replace(trim(upper(adressse)), '\\s+', '-', 'g'), '[^\\p{L}\\p{N}_-]', '', 'g'), 1, 40), '') code, upper(trim(regexp_replace(adressse, '\\s+', ' ', 'g'))) normal, regexp_replace(strip_accents(upper(adressse)), '[^\\x00-\\x7F]', '', 'g') folded, coalesce(regexp_full_match(regexp_replace(c2, '[, ]', '', 'g'), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'), false) \"numeric\" FROM boite")
def clean_codes(spark: SparkSession, d: str) -> DataFrame:
    b, a = table(spark, d, "boite"), F.col("adressse")
    return b.select("fid", T.clean_code(a).alias("code"), T.normalised(a).alias("normal"), T.unaccented(a).alias("folded"), T.is_numeric(F.col("c2")).alias("numeric"))


@query("SELECT entity_id, round(CASE WHEN text IS NULL OR text = '' THEN 0 WHEN h = 0 THEN 0.1 ELSE least(1, 0.3 + 0.7 * h / 3) END, 6) score FROM (SELECT entity_id, text, CAST(regexp_matches(text, '[0-9]') AS INTEGER) + CAST(regexp_matches(text, 'FAT') AS INTEGER) + CAST(regexp_matches(text, '-') AS INTEGER) h FROM intermediate_pipeline_dump)")
def semantic_score(spark: SparkSession, d: str) -> DataFrame:
    p = F.array(F.lit("[0-9]"), F.lit("FAT"), F.lit("-"))
    return table(spark, d, "intermediate_pipeline_dump").select("entity_id", F.round(T.semantic_score(F.col("text"), p), 6).alias("score"))


@query("SELECT type, CASE type WHEN 'INSERT' THEN 'block' WHEN 'CIRCLE' THEN 'circle' WHEN 'TEXT' THEN 'text' WHEN 'MTEXT' THEN 'text' WHEN 'ATTRIB' THEN 'text' ELSE 'outline' END kind, CAST(count(*) AS BIGINT) n FROM intermediate_pipeline_dump GROUP BY 1")
def representation_kinds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "intermediate_pipeline_dump").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return e.select("type", T.representation(F.col("type")).alias("kind"), "n")


@query("SELECT fid, CASE WHEN y > 101000 THEN 'A' WHEN y < 99000 THEN 'B' ELSE 'UNKNOWN' END regime FROM boite")
def regime_hint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "boite").select("fid", T.regime_hint(F.col("y")).alias("regime"))
