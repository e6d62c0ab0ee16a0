"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm.packing import pack
from netloom.llm.tokens import token_counts
from netloom.session import table

CAPACITY = 2048


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, float]]:
    return pack(token_counts(table(spark, d, "documents").select("doc_id", "text")), "doc_id", CAPACITY)


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0]


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers, fill and padding reached, and the fill that batches of single buckets would reach."""
    return spark.createDataFrame(sorted(_packed(spark, d)[1].items()), "metric string, value double")


QUERIES = {"p6_pack": p6_pack, "p6_report": p6_report}
SQL: dict[str, str] = {}
