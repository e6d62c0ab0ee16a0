"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm.mixing import mix, shares
from netloom.llm.tokens import token_counts
from netloom.session import cut, table


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return mix(token_counts(docs), table(spark, d, "mix_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached by the mix."""
    return shares(cut(p7_mix(spark, d)), table(spark, d, "mix_targets"))


QUERIES = {"p7_mix": p7_mix, "p7_report": p7_report}
SQL: dict[str, str] = {}
