"""Spatial views over the tables, the same in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.session import table


def node(spark: SparkSession, d: str) -> DataFrame:
    """The larger boxes with a position: what labels and lines are tied to."""
    b = table(spark, d, "boite").where("type IN ('BPE', 'BPI', 'PTO') AND x IS NOT NULL AND y IS NOT NULL")
    return b.select(F.col("fid").alias("id"), F.col("fid").cast("string").alias("code"), "type", "ref_pm", "capacite", "x", "y")


def site(spark: SparkSession, d: str) -> DataFrame:
    """The branching boxes with a position, and the zone they name."""
    b = table(spark, d, "boite").where("type = 'PBO' AND x IS NOT NULL AND y IS NOT NULL")
    return b.select(F.col("fid").alias("id"), F.col("ref_pm").alias("ref"), "mode_pose", "x", "y")


def zone(spark: SparkSession, d: str, overlap: float = 10.0) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), ((F.col("n_nationkey") % 5) * 200).cast("double").alias("x0"), (F.floor(F.col("n_nationkey") / 5) * 200).cast("double").alias("y0"))
    side = F.when(F.col("id") % 2 == 0, 200.0 + overlap).otherwise(200.0)
    corner = lambda i, j: F.struct((F.col("x0") + i * side).alias("x"), (F.col("y0") + j * side).alias("y"))
    return n.withColumn("ring", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))).withColumn("side", side)


def area(spark: SparkSession, d: str) -> DataFrame:
    """The zones with a ring, one row a delivery."""
    return table(spark, d, "zpm").where("size(ring) >= 3").select(F.col("fid").alias("id"), "code", "ring")


def line(spark: SparkSession, d: str) -> DataFrame:
    """A line for each user, its events in order: a number and the value as coordinates."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.round("value", 2).alias("v"))
    p = F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.col("event_id") % 997).cast("double").alias("x"), F.col("v").alias("y"))))
    return e.groupBy("user_id").agg(p.alias("p")).select(F.col("user_id").alias("id"), F.transform("p", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("points"))


def cable(spark: SparkSession, d: str, reach: float = 40.0, at_site: DataFrame | None = None, at_node: DataFrame | None = None) -> DataFrame:
    """Straight lines from each branching box to the larger boxes within reach, in the zone the branching box names.

    at_site and at_node: id and further columns of the boxes at either end that the lines take along.
    """
    from netloom.operators.joins import candidate_edges

    s, n = site(spark, d), node(spark, d)
    more = lambda df: tuple(c for c in df.columns if c != "id") if df is not None else ()
    with_more = lambda df, extra: df if extra is None else df.join(extra, "id")
    s, n = with_more(s.withColumn("left_p", F.struct("x", "y")), at_site), with_more(n.withColumn("right_p", F.struct("x", "y")), at_node)
    # all that a line has comes along with its pair: there are far more lines than boxes, and they are never shuffled
    e = candidate_edges(s, n, reach, left_cols=("ref", "left_p", *more(at_site)), right_cols=("right_p", *more(at_node)))
    return e.select((F.col("left_id") * 100_000_000 + F.col("right_id")).alias("id"), F.col("left_id").cast("string").alias("from_code"), F.col("right_id").cast("string").alias("to_code"), "ref", F.array("left_p", "right_p").alias("points"), F.lit("cable").alias("layer"), *more(at_site), *more(at_node))


SQL_VIEWS = """
node AS (SELECT fid id, CAST(fid AS VARCHAR) code, type, ref_pm, capacite, x, y FROM boite WHERE type IN ('BPE', 'BPI', 'PTO') AND x IS NOT NULL AND y IS NOT NULL),
csite AS (SELECT fid id, ref_pm AS "ref", mode_pose, x, y FROM boite WHERE type = 'PBO' AND x IS NOT NULL AND y IS NOT NULL),
zones AS (SELECT n_nationkey id, CAST(n_nationkey % 5 * 200 AS DOUBLE) x0, CAST(n_nationkey // 5 * 200 AS DOUBLE) y0, CASE WHEN n_nationkey % 2 = 0 THEN 210.0::DOUBLE ELSE 200.0::DOUBLE END side FROM nation),
areas AS (SELECT fid id, code, ring, len(ring) n FROM zpm WHERE len(ring) >= 3),
sides AS (SELECT id, code, s.p.x px, s.p.y py, s.q.x qx, s.q.y qy FROM (SELECT id, code, unnest(list_transform(range(1, n + 1), lambda i: {'p': ring[i], 'q': ring[i % n + 1]})) s FROM areas)),
pt AS (SELECT user_id id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) k, CAST(event_id % 997 AS DOUBLE) x, round(value, 2) y FROM events)
"""
