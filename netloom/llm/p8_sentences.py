"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm.sentences import sentences
from netloom.session import spread, table


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(spread(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", "start_pos", "end_pos")


QUERIES = {"p8_found": p8_found}
SQL: dict[str, str] = {}
