"""Ordered and ranked operators, all with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.session import cut


def join_groups(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left and right joined on equal columns, NULL equal to NULL; right's copies of them fall away."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]
    return left.join(r, same, how).drop(*[f"__r_{c}" for c in on])


def running_sum(df: DataFrame, group: list[str], order: list[str], amount: str | Column, name: str) -> DataFrame:
    """df with `name`, the sum of amount over a group's rows up to the row itself along `order`.

    Rows are range-partitioned by group and order, so a hot group is spread over tasks; what lies before a partition's
    part of a group is added from the sums of the parts (a row for each group and partition).
    """
    spread = cut(df.withColumn("__run_a", F.col(amount) if isinstance(amount, str) else amount).repartitionByRange(*[F.col(c) for c in [*group, *order]]).withColumn("__run_p", F.spark_partition_id()))
    part = spread.groupBy(*group, "__run_p").agg(F.sum("__run_a").alias("__run_t"))
    before = Window.partitionBy(*group).orderBy("__run_p").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*group, "__run_p", F.coalesce(F.sum("__run_t").over(before), F.lit(0)).alias("__run_o"))
    upto = Window.partitionBy("__run_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = spread.withColumn("__run_k", F.sum("__run_a").over(upto))
    return join_groups(local, part, [*group, "__run_p"]).withColumn(name, F.col("__run_o") + F.col("__run_k")).drop("__run_a", "__run_p", "__run_k", "__run_o")


def rank_in_groups(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with the row number within its group along `order`, from 1; hot groups are spread."""
    return running_sum(df, group, order, F.lit(1).cast("long"), name)


def gaps_and_islands(df: DataFrame, group: list[str], value: str, gap: Column | float) -> DataFrame:
    """df with `island`, numbered from 0 within each group along value: a new one where the step exceeds gap.

    Values are first reduced, map-side, to cells no wider than the gap, within which no step can exceed it; only the
    occupied cells are put in order. gap is one value for each group. A NULL value has no island.
    """
    size = gap if isinstance(gap, Column) else F.lit(float(gap))
    v = F.col(value).cast("double")
    celled = df.withColumns({"__g": size, "__c": F.when(size > 0, F.floor(v / (size * (1 - 1e-9))).cast("double")).otherwise(v)})
    cells = celled.where("__c IS NOT NULL").groupBy(*group, "__c").agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.max("__g").alias("__gap"))
    w = Window.partitionBy(*group).orderBy("__lo")
    new = F.when(F.col("__lo") - F.lag("__hi").over(w) > F.col("__gap"), 1).otherwise(0)
    numbered = cells.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(*group, "__c", "island")
    return join_groups(celled, numbered, [*group, "__c"], "left").drop("__c", "__g")


def axis_outliers(df: DataFrame, group: list[str], value: str, gap_min: float = 100.0, gap_k: float = 0.15) -> DataFrame:
    """df with `island`, `is_body`, `gap` and `separation`: islands along an axis, split where a gap exceeds the larger of gap_min and gap_k times the P10-P90 span.

    The island with most rows (ties: the first) is the body; separation is an island's distance from the body. Rows without a value are left out.
    """
    from netloom.operators.aggregates import quantiles

    known = df.where(F.col(value).isNotNull())
    q = quantiles(known, group, value, [0.1, 0.9]).select(*group, F.greatest(F.lit(float(gap_min)), (F.col("q_90") - F.col("q_10")) * gap_k).alias("gap"))
    marked = cut(gaps_and_islands(join_groups(known, q, group), group, value, F.col("gap")))
    extent = marked.groupBy(*group, "island").agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    body = extent.groupBy(*group).agg(F.max_by(F.struct("island", "__lo", "__hi"), F.struct("__n", F.lit(0) - F.col("island"))).alias("__b"))
    far = join_groups(extent, body, group).select(*group, "island", (F.col("island") == F.col("__b.island")).alias("is_body"), F.greatest(F.lit(0.0), F.when(F.col("__hi") < F.col("__b.__lo"), F.col("__b.__lo") - F.col("__hi")).otherwise(F.col("__lo") - F.col("__b.__hi"))).alias("separation"))
    return join_groups(marked, far, [*group, "island"])


def first_keeps_code(df: DataFrame, group: list[str], code: str, order: list[str]) -> DataFrame:
    """df with `kept_code`: a code stays on its first row along order (a total order), later rows with it get NULL."""
    first = df.where(F.col(code).isNotNull()).groupBy(*group, code).agg(F.min(F.struct(*order)).alias("__first"))
    return join_groups(df, first, [*group, code], "left").withColumn("kept_code", F.when(F.struct(*order) == F.col("__first"), F.col(code))).drop("__first")


def synthetic_codes(df: DataFrame, group: str, code: str, order: list[str], prefix: Column) -> DataFrame:
    """df with `full_code`: rows without a code get the n-th unused PREFIX%04d of their group, in order.

    The unused numbers are those up to as many as there are rows, less the used ones, ranked; no code is made twice. Rows
    of a NULL group stay without.
    """
    made = F.concat(F.col("__p"), F.lpad(F.col("__i").cast("string"), 4, "0"))
    base = df.withColumn("__p", prefix)
    need = base.groupBy(group, "__p").agg(F.count(F.lit(1)).alias("__n"))
    every = need.select(group, "__p", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__i"))
    every = every.select(group, F.when(F.col("__i") > 9999, F.concat("__p", F.col("__i").cast("string"))).otherwise(made).alias("__c"), "__i")
    free = every.join(df.where(F.col(code).isNotNull()).select(F.col(group), F.col(code).alias("__c")).distinct(), [group, "__c"], "left_anti")
    free = rank_in_groups(free, [group], ["__i"], "__k").select(group, "__k", "__c")
    bare = rank_in_groups(df.where(F.col(code).isNull()), [group], order, "__k")
    filled = bare.join(free, [group, "__k"], "left").withColumn("full_code", F.col("__c")).drop("__c", "__k")
    return df.where(F.col(code).isNotNull()).withColumn("full_code", F.col(code)).unionByName(filled)


def unique_suffixes(df: DataFrame, group: list[str], code: str, order: list[str]) -> DataFrame:
    """df with `unique_code`: the second and later rows of a code get -2, -3 and so on, past suffixes that are taken.

    A suffixed code that another row has by itself is skipped: the rows take the free numbers in order. NULL codes stay.
    """
    base = cut(rank_in_groups(df, [*group, code], order, "__r"))
    counts = base.where(F.col(code).isNotNull()).groupBy(*group, code).agg(F.max("__r").alias("__n")).where("__n > 1")
    taken = df.select(*group, F.col(code).alias("__s")).distinct()
    hits = join_groups(counts, taken.select(*group, F.regexp_extract("__s", r"^(.*)-(\d+)$", 1).alias(code), F.try_to_number(F.regexp_extract("__s", r"^(.*)-(\d+)$", 2), F.lit("9999999999")).cast("long").alias("__t")).where("__t >= 2"), [*group, code]).groupBy(*group, code).agg(F.count(F.lit(1)).alias("__m"))
    room = join_groups(counts, hits, [*group, code], "left").select(*group, code, F.explode(F.sequence(F.lit(2).cast("long"), F.col("__n") + F.coalesce("__m", F.lit(0)).cast("long"))).alias("__t"))
    free = join_groups(room.withColumn("__s", F.concat(F.col(code), F.lit("-"), F.col("__t").cast("string"))), taken, [*group, "__s"], "left_anti")
    free = rank_in_groups(free, [*group, code], ["__t"], "__r").select(*group, code, (F.col("__r") + 1).alias("__r"), "__s")
    return join_groups(base, free, [*group, code, "__r"], "left").withColumn("unique_code", F.when((F.col("__r") == 1) | F.col(code).isNull(), F.col(code)).otherwise(F.col("__s"))).drop("__r", "__s")


def best_two(df: DataFrame, group: list[str], distance: str, order: list[str], eps: float) -> DataFrame:
    """One row a group: the nearest candidate, the second's distance and whether the two lie within eps (ambiguous)."""
    w = Window.partitionBy(*group).orderBy(distance, *order)
    r = df.withColumns({"__r": F.row_number().over(w), "second_distance": F.lead(distance).over(w)}).where("__r = 1").drop("__r")
    return r.withColumn("ambiguous", F.coalesce(F.col("second_distance") - F.col(distance) <= eps, F.lit(False)))


def match_both_ways(df: DataFrame, left: str, right: str, score: str, gap: str | None = None) -> DataFrame:
    """(left, right, score, status): one row a left side of the scored pairs.

    no_evidence: best score 0; multiple_optima: several right sides share the best and the least gap (how far the two
    sides' sizes are apart, none NULL) doesn't single one out; contested_layout: several left sides choose the right
    side with the same best score (then all that choose it); outscored_on_layout: another scores higher there; matched.
    Without a choice the least right side stands in the row.
    """
    best = df.groupBy(left).agg(F.max(score).alias("__m"))
    at = df.join(best, left).where(F.col(score) == F.col("__m")).select(left, right, "__m", (F.col(gap) if gap else F.lit(None).cast("double")).alias("__gap"))
    by_gap = at.groupBy(left, "__m", "__gap").agg(F.count(F.lit(1)).alias("__c"), F.min(right).alias("__r"))
    one = by_gap.groupBy(left, "__m").agg(F.sum("__c").alias("__ties"), F.max(F.col("__gap").isNull()).alias("__open"), F.min_by("__c", "__gap").alias("__n"), F.min_by("__r", "__gap").alias("__least"), F.min("__r").alias("__first"))
    choice = F.when(F.col("__m") <= 0, None).when(F.col("__ties") == 1, F.col("__first")).when(~F.col("__open") & (F.col("__n") == 1), F.col("__least"))
    one = cut(one.select(left, F.col("__m").alias(score), choice.alias("__choice"), "__first"))
    claims = one.where("__choice IS NOT NULL").groupBy("__choice", score).agg(F.count(F.lit(1)).alias("__k")).groupBy("__choice").agg(F.max(score).alias("__top"), F.max_by("__k", score).alias("__k"))
    status = F.when(F.col(score) <= 0, "no_evidence").when(F.col("__choice").isNull(), "multiple_optima").when(F.col("__k") > 1, "contested_layout").when(F.col(score) < F.col("__top"), "outscored_on_layout").otherwise("matched")
    return one.join(claims, "__choice", "left").select(left, F.coalesce("__choice", "__first").alias(right), score, status.alias("status"))


def representative(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("__r = 1").drop("__r")


def renumber(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """df with consecutive numbers in a total order, without bringing all rows to one task."""
    return running_sum(df, [], order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) + (start - 1))
