"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.keys import ref_key
from netloom.operators.orphans import classify_references, presence
from netloom.session import cut, table


def states(spark: SparkSession, d: str) -> DataFrame:
    """(src_table, ref_field, load_month, fid, ref_state) of every row of the three reference fields."""
    # the two kinds of target share one filter and one join, told apart by the key's first part
    kind = lambda name, c: F.concat(F.lit(f"{name}:"), ref_key(c))
    site = table(spark, d, "site").where("type = 'PM'").select(kind("pm", "code").alias("k"), "loaded_at", "deleted_at")
    znro = table(spark, d, "znro").select(kind("nro", "ref_nro").alias("k"), "loaded_at", "deleted_at")
    parents = cut(presence(site.unionByName(znro), F.col("k"), F.col("loaded_at"), F.col("deleted_at")))
    refs = []
    for src, fields in (("boite", {"ref_pm": "pm"}), ("zpm", {"ref_sro": "pm", "ref_nro": "nro"})):
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), kind(k, f).alias("k")) for f, k in fields.items()]))
        refs.append(table(spark, d, src).select(F.lit(src).alias("src_table"), "fid", "loaded_at", each.alias("r")).select("src_table", "r.ref_field", "fid", "loaded_at", "r.k"))
    state = classify_references(refs[0].unionByName(refs[1]), F.col("k"), F.col("loaded_at"), parents)
    return state.select("src_table", "ref_field", F.date_format("loaded_at", "yyyy-MM").alias("load_month"), "fid", "ref_state")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return states(spark, d).where("ref_state IN ('never', 'absent')").drop("ref_state")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Per table, field and month: references made, orphans, and how many of them were gone rather than unknown."""
    n = lambda cond: F.sum(F.expr(f"CASE WHEN {cond} THEN 1 ELSE 0 END"))
    return states(spark, d).groupBy("src_table", "ref_field", "load_month").agg(n("ref_state <> 'none'").alias("n_refs"), n("ref_state IN ('never', 'absent')").alias("n_orphans"))


_CTE = r"""
WITH r AS (
  SELECT 'boite' src_table, 'ref_pm' ref_field, strftime(loaded_at, '%Y-%m') load_month, fid, loaded_at, nullif(upper(trim(ref_pm, chr(32) || chr(9))), '') k FROM boite
  UNION ALL SELECT 'zpm', 'ref_sro', strftime(loaded_at, '%Y-%m'), fid, loaded_at, nullif(upper(trim(ref_sro, chr(32) || chr(9))), '') FROM zpm
  UNION ALL SELECT 'zpm', 'ref_nro', strftime(loaded_at, '%Y-%m'), fid, loaded_at, nullif(upper(trim(ref_nro, chr(32) || chr(9))), '') FROM zpm),
p AS (
  SELECT 'pm' kind, upper(trim(code, chr(32) || chr(9))) k, loaded_at, deleted_at FROM site WHERE type = 'PM'
  UNION ALL SELECT 'nro', upper(trim(ref_nro, chr(32) || chr(9))), loaded_at, deleted_at FROM znro),
s AS (
  SELECT r.*, EXISTS (SELECT 1 FROM p WHERE p.k = r.k AND p.kind = CASE WHEN r.ref_field = 'ref_nro' THEN 'nro' ELSE 'pm' END
    AND p.loaded_at <= r.loaded_at AND (p.deleted_at IS NULL OR r.loaded_at < p.deleted_at)) AS here FROM r)
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL = {
    "p1_found": _CTE + "SELECT src_table, ref_field, load_month, fid FROM s WHERE k IS NOT NULL AND NOT here",
    "p1_report": _CTE + "SELECT src_table, ref_field, load_month, CAST(count(k) AS BIGINT) n_refs, CAST(count(*) FILTER (k IS NOT NULL AND NOT here) AS BIGINT) n_orphans FROM s GROUP BY ALL",
}
