"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.keys import ref_key
from netloom.operators.regions import containing_regions
from netloom.operators.spatial import near_pairs
from netloom.session import table

RADIUS = 5.0


def near(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(table(spark, d, "intermediate_pipeline_dump"), "entity_id", "cx", "cy", RADIUS)


def zones(spark: SparkSession, d: str) -> DataFrame:
    """(left_id, right_id) of boxes in a zone that their ref_pm doesn't name."""
    boite, zpm = table(spark, d, "boite"), table(spark, d, "zpm")
    named = F.struct("fid", ref_key("ref_pm").alias("pm"))
    code = F.struct("fid", ref_key("code").alias("pm"))
    held = containing_regions(boite.select(named.alias("box"), "x", "y"), "box", "x", "y", zpm.select(code.alias("zone"), "ring"), "zone", "ring")
    return held.where(~F.col("point_id.pm").eqNullSafe(F.col("region_id.pm")) | F.col("point_id.pm").isNull()).select(F.col("point_id.fid").alias("left_id"), F.col("region_id.fid").alias("right_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near(spark, d).select(F.lit("near").alias("kind"), "left_id", "right_id").unionByName(zones(spark, d).select(F.lit("zone").alias("kind"), "left_id", "right_id"))


_NEAR = """
p AS (SELECT entity_id id, cx x, cy y, CAST(floor(cx / 6) AS BIGINT) a, CAST(floor(cy / 6) AS BIGINT) b FROM intermediate_pipeline_dump WHERE cx IS NOT NULL AND cy IS NOT NULL),
r AS (SELECT id, x, y, a + i a, b + j b FROM p, (VALUES (-1), (0), (1)) t(i), (VALUES (-1), (0), (1)) u(j)),
near AS (SELECT p.id left_id, r.id right_id FROM p JOIN r USING (a, b) WHERE p.id < r.id AND sqrt((p.x - r.x) * (p.x - r.x) + (p.y - r.y) * (p.y - r.y)) <= 5.0)
"""
_ZONE = """
z AS (SELECT fid, nullif(upper(trim(code, chr(32) || chr(9))), '') k, ring, len(ring) n, list_min(list_transform(ring, lambda v: v.x)) x0, list_max(list_transform(ring, lambda v: v.x)) x1, list_min(list_transform(ring, lambda v: v.y)) y0, list_max(list_transform(ring, lambda v: v.y)) y1 FROM zpm WHERE len(ring) >= 3),
g AS (SELECT fid, unnest(range(CAST(floor(x0 / 500) AS BIGINT), CAST(floor(x1 / 500) AS BIGINT) + 1)) gx, y0, y1 FROM z),
h AS (SELECT fid, gx, unnest(range(CAST(floor(y0 / 500) AS BIGINT), CAST(floor(y1 / 500) AS BIGINT) + 1)) gy FROM g),
c AS (SELECT b.fid bf, z.fid zf, b.x, b.y, z.ring, z.n FROM boite b JOIN h ON h.gx = CAST(floor(b.x / 500) AS BIGINT) AND h.gy = CAST(floor(b.y / 500) AS BIGINT) JOIN z ON z.fid = h.fid
  WHERE b.x BETWEEN z.x0 AND z.x1 AND b.y BETWEEN z.y0 AND z.y1 AND (nullif(upper(trim(b.ref_pm, chr(32) || chr(9))), '') IS DISTINCT FROM z.k OR z.k IS NULL)),
e AS (SELECT bf, zf, x, y, unnest(list_transform(range(1, n + 1), lambda i: {'p': ring[i], 'q': ring[i % n + 1]})) s FROM c),
f AS (SELECT bf, zf, s.p.x - x px, s.p.y - y py, s.q.x - x qx, s.q.y - y qy FROM e),
zone AS (SELECT bf left_id, zf right_id FROM f GROUP BY bf, zf
  HAVING bool_or(px * qy - py * qx = 0 AND least(px, qx) <= 0 AND greatest(px, qx) >= 0 AND least(py, qy) <= 0 AND greatest(py, qy) >= 0)
  OR sum(CASE WHEN (py > 0) <> (qy > 0) AND (px * qy - py * qx > 0) = (qy > py) THEN 1 ELSE 0 END) % 2 = 1)
"""

QUERIES = {"p4_found": p4_found}
SQL = {"p4_found": f"WITH {_NEAR}, {_ZONE} SELECT 'near' kind, left_id, right_id FROM near UNION ALL SELECT 'zone', left_id, right_id FROM zone"}
