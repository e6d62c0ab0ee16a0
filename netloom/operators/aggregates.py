"""Aggregations of the conversion and its reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.functions.keys import is_empty, ref_key


def _n(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def null_counts(df: DataFrame, fields: list[str], top: int | None = None) -> DataFrame:
    """(field, n_empty) of the fields with null or blank values, in one pass over the rows; most first, then by name."""
    one = df.agg(*[F.coalesce(_n(is_empty(F.col(f).cast("string"))), F.lit(0)).alias(f) for f in fields])
    out = one.unpivot([], fields, "field", "n_empty").where("n_empty > 0")
    return out.orderBy(F.desc("n_empty"), "field").limit(top) if top else out


def duplicate_codes(df: DataFrame, code: str) -> DataFrame:
    """(code, n) of codes that stand on several rows, trimmed but with regard to case."""
    return df.select(F.trim(F.col(code)).alias("code")).where("code <> ''").groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def balance(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, left_sum, right_sum, diff): sums of (key, value) on either side, a side without the key counts as 0."""
    sums = lambda df, name: df.select(ref_key(key).alias("key"), F.col("value").try_cast("long").alias("v")).where("key IS NOT NULL").groupBy("key").agg(F.coalesce(F.sum("v"), F.lit(0)).alias(name))
    j = sums(left, "left_sum").join(sums(right, "right_sum"), "key", "full_outer").fillna(0, ["left_sum", "right_sum"])
    return j.withColumn("diff", F.col("left_sum") - F.col("right_sum"))


def vocabulary_violations(df: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """(field, value, n) of non-blank values outside a field's list, upper case and trimmed."""
    long = df.select(*[F.upper(F.trim(F.col(f).cast("string"))).alias(f) for f in fields]).unpivot([], list(fields), "field", "value").where("value <> ''")
    bad = reduce(lambda a, b: a | b, [(F.col("field") == f) & ~F.col("value").isin(v) for f, v in fields.items()])
    return long.where(bad).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def provenance(df: DataFrame, fc: str, kinds: dict[str, str]) -> DataFrame:
    """(fc, field, provenance, n): non-empty values of each field, by where they come from."""
    one = df.agg(*[F.coalesce(_n(~is_empty(F.col(f).cast("string"))), F.lit(0)).alias(f) for f in kinds])
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return one.unpivot([], list(kinds), "field", "n").where("n > 0").select(F.lit(fc).alias("fc"), "field", F.element_at(kind, F.col("field")).alias("provenance"), "n")


def provenance_coverage(actual: DataFrame, recorded: DataFrame, known: list[str]) -> DataFrame:
    """(fc, field, state): 'missing' where values have no record, 'stale' where a record has no values, 'unknown_kind' for other kinds."""
    r = recorded.groupBy("fc", "field").agg(F.max(F.when(~F.col("provenance").isin(known), 1).otherwise(0)).alias("odd"))
    j = actual.select("fc", "field", F.lit(1).alias("here")).distinct().join(r, ["fc", "field"], "full_outer")
    return j.select("fc", "field", F.when(F.col("odd").isNull(), "missing").when(F.col("here").isNull(), "stale").when(F.col("odd") == 1, "unknown_kind").otherwise("ok").alias("state"))


def conservation(features: DataFrame, drops: DataFrame, excluded: list[str]) -> DataFrame:
    """(disposition, layer, n): weights of features and counts of drops, ports named in excluded left out, only n > 0.

    features: disposition, layer, weight; drops: port, layer, n.
    """
    rows = features.select("disposition", "layer", F.col("weight").cast("long").alias("n")).unionByName(drops.where(~F.col("port").isin(excluded)).select(F.col("port").alias("disposition"), "layer", F.col("n").cast("long")))
    return rows.groupBy("disposition", "layer").agg(F.sum("n").alias("n")).where("n > 0")


def conservation_check(ledger: DataFrame, expected: int) -> DataFrame:
    """(total, expected, ok) of a ledger; an empty one sums to 0."""
    return ledger.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).select("total", F.lit(expected).cast("long").alias("expected"), (F.col("total") == expected).alias("ok"))


def top_counts(df: DataFrame, keys: list[str], top: int | None = None) -> DataFrame:
    """(keys, n), most first, then by key."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), *keys).limit(top) if top else out


def majority(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n): the value that occurs most, the least one on ties; counted map-side before the choice."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), value))).where("__r = 1").drop("__r")


def _ranked(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, __c, __upto, n): distinct values with their count, the rows up to them and the group's rows."""
    from netloom.operators.windows import join_groups, running_sum

    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = running_sum(counts, group, [value], "__c", "__upto")
    return join_groups(ranked, counts.groupBy(*group).agg(F.sum("__c").alias("n")), group)


def upper_median(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, median, n): the upper of the two middle values, NULLs left out.

    Equal values are counted map-side and ranked over range partitions, so a hot group is spread over tasks.
    """
    middle = F.floor(F.col("n") / 2) + 1
    return _ranked(df, group, value).where((F.col("__upto") >= middle) & (F.col("__upto") - F.col("__c") < middle)).select(*group, F.col(value).alias("median"), "n")


def quantiles(df: DataFrame, group: list[str], value: str, at: list[float]) -> DataFrame:
    """(group, q_<percent>): exact quantiles with linear interpolation, NULLs left out; values are ranked over range partitions."""
    at_rank = lambda k: (F.col("__upto") - F.col("__c") <= k) & (k < F.col("__upto"))
    pos = [(F.col("n") - 1) * F.lit(float(q)) for q in at]
    pick = [F.max(F.when(at_rank(k), F.col(value).cast("double"))).alias(f"__{e}{i}") for i, p in enumerate(pos) for e, k in (("lo", F.floor(p)), ("hi", F.ceil(p)))]
    r = _ranked(df, group, value).where(reduce(lambda a, b: a | b, [at_rank(F.floor(p)) | at_rank(F.ceil(p)) for p in pos]))
    w = r.groupBy(*group, "n").agg(*pick)
    return w.select(*group, *[(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (p - F.floor(p))).alias(f"q_{round(q * 100)}") for i, (p, q) in enumerate(zip(pos, at))])


def qc_summary(features: DataFrame, classes: list[str]) -> DataFrame:
    """(fc_name, n, outliers, confidence, note) of every class, also of those without features."""
    f = features.groupBy("fc_name").agg(F.count(F.lit(1)).alias("n"), _n(F.col("geographic_outlier")).alias("outliers"), F.avg("classification_confidence").alias("confidence"))
    every = features.sparkSession.createDataFrame([(c,) for c in classes], "fc_name string")
    return every.join(F.broadcast(f) if len(classes) < 1000 else f, "fc_name", "left").select("fc_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("outliers", F.lit(0)).alias("outliers"), "confidence", F.when(F.col("n").isNull(), "empty in the source").otherwise("").alias("note"))


def candidate_consistency(candidates: DataFrame, codes: DataFrame, statuses: list[str]) -> DataFrame:
    """(problem, n): unknown statuses, keys with several selections and selections whose code no target has.

    candidates: annotation_key, target_code, selected, status; codes: code.
    """
    bad = candidates.where(~F.col("status").isin(statuses) | F.col("status").isNull()).agg(F.count(F.lit(1)).alias("n")).select(F.lit("bad_status").alias("problem"), "n")
    many = candidates.where("selected = 1").groupBy("annotation_key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("several_selected").alias("problem"), "n")
    lost = candidates.where("selected = 1 AND target_code IS NOT NULL").join(codes.select(ref_key("code").alias("__c")).distinct(), ref_key("target_code") == F.col("__c"), "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unresolved_code").alias("problem"), "n")
    return bad.unionByName(many).unionByName(lost)


def verdict(rules: DataFrame) -> DataFrame:
    """One row: errors (severities C and E), warnings and the verdict FAIL, QUARANTINE or PASS. rules: severity, status."""
    failed = F.col("status") != "PASS"
    r = rules.agg(F.coalesce(_n(failed & F.col("severity").isin("C", "E")), F.lit(0)).alias("errors"), F.coalesce(_n(failed & (F.col("severity") == "W")), F.lit(0)).alias("warnings"), F.coalesce(_n(~failed), F.lit(0)).alias("rules_passed"), F.coalesce(_n(failed), F.lit(0)).alias("rules_failed"))
    return r.withColumn("verdict", F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "QUARANTINE").otherwise("PASS"))


def residual_gate(df: DataFrame, dx: str, dy: str, good: float = 0.0012, bad: float = 0.0015, group: list[str] | None = None) -> DataFrame:
    """(group, n, max_residual, mean_residual, gate): residuals of control points, PASS to good, WARN to bad, FAIL beyond; PRECISION_COARSE without any."""
    r = df.select(*(group or []), F.sqrt(F.col(dx) * F.col(dx) + F.col(dy) * F.col(dy)).alias("r")).groupBy(*(group or [])).agg(F.count("r").alias("n"), F.max("r").alias("max_residual"), F.avg("r").alias("mean_residual"))
    return r.withColumn("gate", F.when(F.col("n") == 0, "PRECISION_COARSE").when(F.col("max_residual") > bad, "FAIL").when(F.col("max_residual") > good, "WARN").otherwise("PASS"))


def regime_vote(df: DataFrame, group: list[str], y: str, hint: str) -> DataFrame:
    """(group, n, regime, strength): the hint most entities of a cluster have and its share."""
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    top = majority(df, group, hint)
    return top.join(n, group).select(*group, F.col("total").alias("n"), F.col(hint).alias("regime"), (F.col("n") / F.col("total")).alias("strength"))
