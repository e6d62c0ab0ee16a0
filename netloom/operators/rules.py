"""Acceptance rules: each gives one row (rule_id, severity, status, n_violations, n_evidence); their union has a verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.geo import parse_epsg
from netloom.operators import joins
from netloom.operators.aggregates import balance, duplicate_codes, null_counts, vocabulary_violations

SCHEMA = "rule_id string, severity string, status string, n_violations long, n_evidence long"


def rule(rule_id: str, severity: str, violations: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """PASS without violations; evidence counts the rows the rule looked at, so an empty pass can be told."""
    v = violations.agg(F.count(F.lit(1)).alias("n_violations"))
    e = (evidence if evidence is not None else violations).agg(F.count(F.lit(1)).alias("n_evidence"))
    # two rows of one column each side by side, joined on a constant of one row either side
    j = v.withColumn("__k", F.lit(rule_id)).join(e.withColumn("__k", F.lit(rule_id)), "__k")
    return j.select(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.when(F.col("n_violations") == 0, "PASS").otherwise("FAIL").alias("status"), "n_violations", "n_evidence")


def static(spark: SparkSession, rule_id: str, severity: str, n_violations: int, n_evidence: int) -> DataFrame:
    """A rule decided from the catalogue alone."""
    return spark.createDataFrame([(rule_id, severity, "FAIL" if n_violations else "PASS", n_violations, n_evidence)], SCHEMA)


def layers_present(spark: SparkSession, layers: dict[str, DataFrame], expected: list[str]) -> DataFrame:
    return static(spark, "1.1", "C", len(set(expected) - set(layers)), len(expected))


def geometry_types(rule_id: str, layer: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return rule(rule_id, "E", layer.select(F.upper(F.col(column)).alias("t")).distinct().where(~F.col("t").isin([a.upper() for a in allowed])), layer)


def one_crs(spark: SparkSession, crs: dict[str, str | None], expected: str | None) -> DataFrame:
    """All layers in one coordinate system, the expected one if named; a layer without one is a violation."""
    codes = {k: parse_epsg(v) for k, v in crs.items()}
    want = parse_epsg(expected)
    bad = sum(c is None or (want is not None and c != want) for c in codes.values()) + max(0, len({c for c in codes.values() if c is not None}) - 1)
    return static(spark, "2.0", "C", bad, len(crs))


def not_empty(layers: dict[str, DataFrame], expected: list[str], spark: SparkSession) -> DataFrame:
    counts = [layers[e].agg(F.count(F.lit(1)).alias("n")) for e in expected if e in layers]
    missing = sum(e not in layers for e in expected)
    one = reduce(DataFrame.unionByName, counts) if counts else spark.createDataFrame([], "n long")
    return one.agg((F.coalesce(F.sum(F.when(F.col("n") == 0, 1).otherwise(0)), F.lit(0)) + missing).alias("n_violations")).select(F.lit("3.0").alias("rule_id"), F.lit("C").alias("severity"), F.when(F.col("n_violations") == 0, "PASS").otherwise("FAIL").alias("status"), F.col("n_violations").cast("long"), F.lit(len(expected)).cast("long").alias("n_evidence"))


def mandatory(rule_id: str, layer: DataFrame, fields: list[str]) -> DataFrame:
    return rule(rule_id, "E", null_counts(layer, fields), layer)


def unique(rule_id: str, layer: DataFrame, code: str) -> DataFrame:
    return rule(rule_id, "E", duplicate_codes(layer, code), layer)


def isolation(rule_id: str, left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    return rule(rule_id, "E", joins.isolation(left, left_key, right, right_key), left)


def reference_isolation(rule_id: str, parents: DataFrame, key: str, children: DataFrame, child_id: str, ref: str) -> DataFrame:
    """Children without a parent (also those that name none) and parents without a child."""
    return rule(rule_id, "E", joins.reference_isolation(parents, key, children, child_id, ref), children)


def foreign_key(rule_id: str, child: DataFrame, field: str, parent: DataFrame, key: str) -> DataFrame:
    """Codes of the child's field that no parent has."""
    return rule(rule_id, "E", joins.code_set(child, field).join(joins.code_set(parent, key), "code", "left_anti"), child)


def no_overlap(rule_id: str, regions: DataFrame, region_id: str, ring: str, cell_size: float) -> DataFrame:
    return rule(rule_id, "E", joins.overlapping_regions(regions, region_id, ring, cell_size), regions)


def inside(rule_id: str, points: DataFrame, point_id: str, ref: str, regions: DataFrame, code: str, ring: str) -> DataFrame:
    return rule(rule_id, "E", joins.outside_named_region(points, point_id, ref, regions, code, ring), points)


def at_most(rule_id: str, layer: DataFrame, used: str, total: str) -> DataFrame:
    """Rows that use more than they have; nulls and texts that are no integers are skipped."""
    u, t = F.col(used).try_cast("long"), F.col(total).try_cast("long")
    return rule(rule_id, "E", layer.where(u > t), layer.where(u.isNotNull() & t.isNotNull()))


def balanced(rule_id: str, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    b = balance(left, right, key)
    return rule(rule_id, "E", b.where("diff > 0"), b)


def vocabulary(rule_id: str, layer: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    return rule(rule_id, "W", vocabulary_violations(layer, fields), layer)


def report(rules: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [r.select("rule_id", "severity", "status", "n_violations", "n_evidence") for r in rules])
