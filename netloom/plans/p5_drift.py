"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.drift import SEP, consistent_table, drift_events, lineages
from netloom.session import cut, table

#: Values that identify a box: type, area and number.
BOX_CODE = r"\s*(?i:PBO|BPE|BPI|PTO)-[A-Za-z]{3}-\d+\s*"
#: Columns of the one table: names of the BOITE layer and of the measurements some series carry.
COLUMNS = {"CODE": "string", "CODE_PTC": "string", "REF_PM": "string", "CAPACITE": "int", "NB_FIBRE_UTIL": "int", "NB_SPLICES": "int", "PROPRIETAIRE": "string", "VILLE": "string", "X": "double", "Y": "double", "ALTITUDE": "double", "NOTE_QC": "double", "DATE_POSE": "string", "NUM_PLAN": "string", "EN_SERVICE": "string", "VISITE": "string", "PHOTO": "string", "c2": "string"}


def events(spark: SparkSession, d: str) -> DataFrame:
    return drift_events(table(spark, d, "boite_raw"), BOX_CODE)


def _dotted(c: str) -> Column:
    return F.replace(c, F.lit(SEP), F.lit("."))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The events of every file; a nested field that moved below another parent has a new name for the same values."""
    kind = F.when(F.col("drift_kind") == "moved", "renamed").otherwise(F.col("drift_kind"))
    return events(spark, d).select("file_id", _dotted("field_path").alias("field_name"), kind.alias("drift_kind"), _dotted("prev_path").alias("prev_name"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """How often each field was added, removed, renamed, moved or changed in type."""
    return events(spark, d).groupBy(_dotted("field_path").alias("field_name"), "drift_kind", _dotted("prev_path").alias("prev_name")).agg(F.count(F.lit(1)).alias("n_files"))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """All deliveries as one box table."""
    raw = table(spark, d, "boite_raw")
    names = lineages(raw, cut(events(spark, d)), list(COLUMNS))
    return consistent_table(raw, names, COLUMNS)


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_table": p5_table}
SQL: dict[str, str] = {}
