"""Legend clusters that lie off a drawing's body."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.functions.text import normalised
from netloom.operators.graph import merge_groups
from netloom.operators.joins import points_in_boxes
from netloom.operators.windows import axis_outliers, join_groups
from netloom.session import cut

#: Terms that title a legend (fixed values).
ANCHORS = ["LEGEND", "LEGENDA", "SYMBOL", "SIMBOL", "DESIGN SUMMARY", "SPLICING", "CABLE TYPE", "KETERANGAN", "FDT", "LAYOUT"]


def legend_clusters(features: DataFrame, by: list[str] | None = None, gap_min: float = 100.0, gap_k: float = 0.15, min_features: int = 10, min_cluster: int = 3, max_fraction: float = 0.5, fence_min: float = 10.0, fence_k: float = 0.25, min_confidence: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(clusters, members) of features (id, x, y, text and the columns of `by`, one drawing each; the whole table is one without).

    On each axis a drawing's features fall into islands at wide gaps; islands other than the most populous are outlier
    groups, and groups that share members merge (greatest separation, greatest gap). A group of min_cluster members up to
    max_fraction of the drawing's counts; its confidence is 0.6 for its separation from the body (saturating at twice
    the gap) and 0.4 for an anchor text among its members or in its box, widened by fence_k of the diagonal.
    clusters: by, cluster LC-nnn by (-confidence, -members), members, axes, anchors, confidence and box; members: by,
    cluster, id. Drawings of fewer than min_features features, or none off the body, give none. Features without x or y
    don't count; ids are unique.
    """
    by = list(by or [])
    key = by or ["__all"]
    f = cut((features if by else features.withColumn("__all", F.lit(1))).where("x IS NOT NULL AND y IS NOT NULL").select(*key, "id", "x", "y", "text"))
    totals = f.groupBy(*key).agg(F.count(F.lit(1)).alias("__total"))
    name = lambda axis: F.concat_ws("\u001f", *[F.coalesce(F.col(k).cast("string"), F.lit("\u001e")) for k in key], F.lit(axis), F.col("island").cast("string"))
    groups = [axis_outliers(f.select(*key, "id", axis), key, axis, gap_min, gap_k).where("NOT is_body").select(*key, name(axis).alias("group"), F.lit(axis).alias("axis"), F.col("id").alias("member"), "separation", "gap") for axis in ("x", "y")]
    groups = cut(reduce(DataFrame.unionByName, groups))
    merged = groups.join(merge_groups(groups.select("group", "member")), "group")
    found = merged.groupBy(*key, "merged").agg(F.countDistinct("member").alias("members"), F.array_join(F.array_sort(F.collect_set("axis")), ",").alias("axes"), F.max("separation").alias("separation"), F.max("gap").alias("gap"))
    found = cut(join_groups(found, totals, key).where((F.col("__total") >= min_features) & (F.col("members") >= min_cluster) & (F.col("members") <= max_fraction * F.col("__total"))).drop("__total"))
    inside = cut(merged.select("merged", F.col("member").alias("id")).distinct().join(found.select("merged"), "merged", "left_semi").join(f, "id"))
    box = inside.groupBy("merged").agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))
    diagonal = F.sqrt((F.col("xmax") - F.col("xmin")) * (F.col("xmax") - F.col("xmin")) + (F.col("ymax") - F.col("ymin")) * (F.col("ymax") - F.col("ymin")))
    fence = F.greatest(F.lit(fence_min), diagonal * fence_k)
    fences = found.select(*key, "merged").join(box, "merged").select(*key, F.col("merged").alias("id"), (F.col("xmin") - fence).alias("xmin"), (F.col("xmax") + fence).alias("xmax"), (F.col("ymin") - fence).alias("ymin"), (F.col("ymax") + fence).alias("ymax"))
    # members lie in their own box, so the fence finds their texts too
    held = cut(f.where("text IS NOT NULL").withColumn("terms", F.filter(F.array(*[F.lit(a) for a in ANCHORS]), lambda a: F.contains(normalised(F.col("text")), a))).where("size(terms) > 0"))
    hits = points_in_boxes(held, fences, gap_min, key).join(held.select(F.col("id").alias("point_id"), F.explode("terms").alias("term")), "point_id").select("box_id", "term").distinct()
    anchors = hits.groupBy("box_id").agg(F.collect_set("term").alias("t")).select(F.col("box_id").alias("merged"), F.array_sort(F.filter("t", lambda a: ~F.exists(F.col("t"), lambda b: (b != a) & F.contains(b, a)))).alias("anchors"))
    c = found.join(box, "merged").join(anchors, "merged", "left")
    c = c.withColumn("confidence", 0.6 * F.least(F.lit(1.0), F.col("separation") / (2 * F.col("gap"))) + 0.4 * F.when(F.size("anchors") > 0, 1.0).otherwise(0.0)).where(F.col("confidence") >= min_confidence)
    order = Window.partitionBy(*key).orderBy(F.desc("confidence"), F.desc("members"), "xmin", "ymin", "merged")
    c = cut(c.withColumn("confidence", F.round("confidence", 4)).withColumn("cluster", F.format_string("LC-%03d", F.row_number().over(order))))
    members = inside.select("merged", "id").join(c.select(*by, "merged", "cluster"), "merged").select(*by, "cluster", "id")
    return c.select(*by, "cluster", "members", "axes", F.coalesce("anchors", F.array().cast("array<string>")).alias("anchors"), "confidence", F.round("separation", 4).alias("separation"), "xmin", "xmax", "ymin", "ymax"), members


def confirmed(members: DataFrame, points: DataFrame, boxes: list[tuple[float, float, float, float]], ids: list, coverage: float = 0.9) -> DataFrame:
    """(cluster, confirmed): whether `coverage` of a cluster's members lie in one of the boxes (xmin, ymin, xmax, ymax) or are among the ids."""
    j = members.join(points.select("id", "x", "y"), "id")
    shares = [F.avg(F.when(F.col("x").between(b[0], b[2]) & F.col("y").between(b[1], b[3]), 1.0).otherwise(0.0)) for b in boxes]
    shares.append(F.avg(F.when(F.col("id").isin(ids or [""]), 1.0).otherwise(0.0)))
    return j.groupBy("cluster").agg((F.greatest(*shares) if len(shares) > 1 else shares[0]).alias("s")).select("cluster", (F.col("s") >= coverage).alias("confirmed"))


def exclude_legends(features: DataFrame, members: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantine): features (id) less those of confirmed clusters; members of clusters not confirmed stay and are listed for review.

    members: cluster, id; states: cluster, confirmed. quarantine: id, cluster, reason.
    """
    j = cut(members.join(states, "cluster"))
    return features.join(j.where("confirmed").select("id"), "id", "left_anti"), j.where("NOT confirmed").select("id", "cluster", F.lit("legend_candidate").alias("reason"))
