"""Queries of problem 2."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.vocabulary import UNMATCHED, map_rows
from netloom.session import table

FIELDS = (("zpm", "statut"), ("boite", "type"), ("boite", "mode_pose"))


def mapped(spark: SparkSession, d: str) -> DataFrame:
    rows = [table(spark, d, t).select(F.lit(f"{t}.{c}").alias("field_name"), F.col("fid").alias("id"), F.col(c).alias("value")) for t, c in FIELDS]
    return map_rows(reduce(DataFrame.unionByName, rows), table(spark, d, "domain_vocab"), ["canon_value", "label_fr", "label_en"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d).select("field_name", F.col("id").alias("fid"), "canon_value")


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that mean no entry, with how often they were typed."""
    return mapped(spark, d).where(F.col("canon_value") == UNMATCHED).groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p2_found": p2_found, "p2_unmatched": p2_unmatched}
SQL: dict[str, str] = {}
