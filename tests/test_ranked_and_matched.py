"""Ranks over range partitions, matching, isolation and text forms, against values written out by hand."""

from pyspark.sql import functions as F

from netloom.functions import geo as G
from netloom.functions import text as T
from netloom.operators import aggregates as A
from netloom.operators import joins as J
from netloom.operators import topology as P
from netloom.operators import windows as W


def test_label_scores_count_whole_prefixes(spark):
    c = spark.createDataFrame([("C1", "FDT-01"), ("C1", " fdt-01.a "), ("C1", "FDT-01X"), ("C1", "FDT-01.B.C"), ("C1", "Z"), ("C2", "FDT-01X"), ("C3", None)], "component string, label string")
    y = spark.createDataFrame([("FDT-01", "FDT-01.A"), ("FDT-01", "Z"), ("FDT-02", "Q")], "layout string, label string")
    assert [tuple(r) for r in J.label_scores(c, y).collect()] == [("C1", "FDT-01", 2, 2, 6)]


def test_matching_statuses(spark):
    rows = [("a", "X", 5, 1.0), ("a", "Y", 3, 0.0), ("b", "X", 4, 1.0), ("c", "Y", 2, 3.0), ("c", "Z", 2, 1.0), ("d", "V", 2, 1.0), ("d", "W", 2, 1.0), ("e", "X", 0, 1.0), ("f", "U", 7, 0.0), ("g", "U", 7, 0.0), ("h", "U", 6, 0.0), ("i", "T", 2, None), ("i", "S", 2, 1.0)]
    got = {r["l"]: (r["r"], r["status"]) for r in W.match_both_ways(spark.createDataFrame(rows, "l string, r string, score int, gap double"), "l", "r", "score", "gap").collect()}
    assert got == {"a": ("X", "matched"), "b": ("X", "outscored_on_layout"), "c": ("Z", "matched"), "d": ("V", "multiple_optima"), "e": ("X", "no_evidence"), "f": ("U", "contested_layout"), "g": ("U", "contested_layout"), "h": ("U", "contested_layout"), "i": ("S", "multiple_optima")}
    assert W.match_both_ways(spark.createDataFrame([], "l string, r string, score int"), "l", "r", "score").count() == 0


def test_reference_isolation_counts_blank_references(spark):
    p = spark.createDataFrame([("PM-1",), ("PM-2",), (None,)], "code string")
    c = spark.createDataFrame([(1, " pm-1"), (2, None), (3, "  "), (4, "PM-9")], "fid long, ref string")
    assert sorted(tuple(r) for r in J.reference_isolation(p, "code", c, "fid", "ref").collect()) == [("child", "2"), ("child", "3"), ("child", "4"), ("parent", "PM-2")]


def test_chain_codes_skip_used_ones(spark):
    c = spark.createDataFrame([("x", "CB", 9.0), ("y", "CB", 5.0), ("z", "CB", 5.0), ("w", None, 1.0)], "chain string, code string, length double")
    used = spark.createDataFrame([("CB",), ("CB-S2",)], "code string")
    assert {r["chain"]: r["chain_code"] for r in P.chain_codes(c, "code", used).collect()} == {"x": "CB", "y": "CB-S1", "z": "CB-S3", "w": None}


def test_residual_gate(spark):
    gate = lambda *v: A.residual_gate(spark.createDataFrame([(x, 0.0) for x in v], "dx double, dy double"), "dx", "dy").first()["gate"]
    assert [gate(0.0012), gate(0.0013), gate(0.0016, 0.0), gate(150.0), gate(None)] == ["PASS", "WARN", "FAIL", "FAIL", "PRECISION_COARSE"]


def test_names_of_blocks_and_sheets(spark):
    names = ["FDT-01", "New POLE 7", "NRO north", "arrow", "Cabinet 3", "shelter", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(T.block_class(F.col("n"))).collect()] == ["BOITE", "PTECH", "SITE", "PTECH", "BOITE", "SITE", "PTECH"]
    assert spark.range(1).select(T.layout_disposition(F.lit("FDT-ALL"))).first()[0] == "fdt_tagging"


def test_numbers_keep_the_digits_they_have(spark):
    values = [11402817.206054688, -0.25, 0.9999999999999, -32779.220703125, 1e16, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(G.fixed(F.col("v"), 12)).collect()] == [f"{v:.12f}" for v in values]
    two = spark.range(1).select(F.array(G.point(F.lit(0.0), F.lit(0.0)), G.point(F.lit(5.0), F.lit(0.0))).alias("p"))
    assert two.select(G.aspect_ratio(F.col("p"))).first()[0] == 1.0


def test_ranks_and_islands_of_a_hot_group(spark):
    rows = [(None if k % 3 == 0 else "g", float(k * 7 % 100), k) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(5)
    want = {}
    for g in (None, "g"):
        for i, (_, _, k) in enumerate(sorted(r for r in rows if r[0] == g) if g else sorted((r for r in rows if r[0] is None), key=lambda r: r[1:])):
            want[k] = i + 1
    assert {r["id"]: r["n"] for r in W.rank_in_groups(df, ["g"], ["v", "id"], "n").collect()} == want
    pts = [("a", v) for v in (0.0, 1.0, 1.5, 4.0, 4.0, 9.5, 10.4)] + [("a", None), ("b", 3.0)]
    got = {(r["g"], r["v"]): r["island"] for r in W.gaps_and_islands(spark.createDataFrame(pts, "g string, v double"), ["g"], "v", 2.5).collect()}
    assert got == {("a", 0.0): 0, ("a", 1.0): 0, ("a", 1.5): 0, ("a", 4.0): 0, ("a", 9.5): 1, ("a", 10.4): 1, ("a", None): None, ("b", 3.0): 0}
    q = A.quantiles(spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 10)], "g string, v double"), ["g"], "v", [0.5, 0.9]).first()
    assert (q["q_50"], round(q["q_90"], 9)) == (2.5, 7.9)
    assert W.first_keeps_code(spark.createDataFrame([(1, "A"), (2, "A"), (3, None)], "id long, c string"), [], "c", ["id"]).where("kept_code IS NOT NULL").count() == 1


def test_boxes_of_any_size(spark):
    p = spark.createDataFrame([("d", 1, 0.0, 0.0), ("d", 2, 5e6, 4e4), ("e", 3, 1.0, 1.0), ("d", 4, None, 1.0)], "d string, id long, x double, y double")
    b = spark.createDataFrame([("d", 1, 0.0, 6e6, -1e5, 1e5), ("d", 2, 0.0, 0.0, 0.0, 0.0), ("e", 3, 2.0, 1.0, 0.0, 1.0)], "d string, id long, xmin double, xmax double, ymin double, ymax double")
    assert sorted(tuple(r) for r in J.points_in_boxes(p, b, 100.0, ["d"]).collect()) == [(1, 1), (1, 2), (2, 1)]
