"""The conversion as one run and its stages, against values written out by hand."""

from pyspark.sql import functions as F

from netloom.operators import pipeline as L
from netloom.operators import rules as R

ENTITY = "id string, layer string, text string, x double, y double, method string"


def entities():
    rows = [(f"body-{i}", "FAT CODE", f"F{i}", 500000.0 + (i % 20) * 100, 60000.0 + (i // 20) * 100, "clash") for i in range(200)]
    rows += [(f"legend-{j}", "CABLE", {0: "LEGENDA", 1: "CABLE TYPE"}.get(j, "x"), 504900.0 + (j % 2) * 40, 60300.0 + (j // 2) * 30, None) for j in range(12)]
    rows += [("n", "Legend", "t", 500000.0, 60000.0, None), ("e", "FAT CODE", "  ", 500000.0, 60000.0, None), ("z", "FAT CODE", "t", None, 60000.0, None), ("q", None, "nothing", 500001.0, 60000.0, None)]
    return rows


def test_every_entity_is_in_the_ledger_once(spark):
    df = spark.createDataFrame(entities(), ENTITY).drop("method")
    run = L.convert(df, ["BOITE", "CABLE"], confirmed=0.8)
    ledger = {(r["disposition"], r["layer"]): r["n"] for r in run.ledger.collect()}
    assert ledger == {("mapped", "FAT CODE"): 200, ("legend", "CABLE"): 12, ("negative_evidence", "Legend"): 1, ("empty_text", "FAT CODE"): 1, ("invalid_coordinate", "FAT CODE"): 1, ("unclassified", None): 1}
    assert {r["rule_id"]: (r["severity"], r["status"], r["n_violations"]) for r in run.rules.collect()} == {"3.0": ("C", "FAIL", 1), "8.1": ("I", "PASS", 0), "9.1": ("W", "FAIL", 1)}
    assert run.verdict.first()["verdict"] == "FAIL" and run.quarantine.count() == 0
    open_run = L.convert(df, ["BOITE"], confirmed=1.1)
    assert open_run.features.count() == 213 and open_run.quarantine.count() == 12 and open_run.verdict.first()["verdict"] == "QUARANTINE"
    empty = L.convert(df.limit(0), ["BOITE"], confirmed=0.8)
    assert empty.ledger.count() == 0 and empty.rules.where("rule_id = '8.1'").first()["status"] == "PASS"


def test_gate(spark):
    bad = R.static(spark, "8.2", "I", 3, 5)
    assert tuple(L.gate(bad, False).first())[1:3] == ("I", "WARN") and tuple(L.gate(bad, True).first())[1:3] == ("E", "FAIL")
    assert L.gate(R.static(spark, "8.2", "I", 0, 5), False).first()["status"] == "PASS"


def test_label_families_have_their_own_targets(spark):
    labels = spark.createDataFrame([(1, 0.0, 0.0, "DMPH-1.1.A01"), (2, 0.0, 10.0, "MR.DMPH.P7"), (3, 0.0, 20.0, " any "), (4, 500.0, 0.0, "any"), (5, 100.0, 0.0, "DMPH-1.2.A01"), (6, 0.0, 10.0, None)], "id long, x double, y double, text string")
    targets = spark.createDataFrame([(11, 1.0, 0.0, "PTECH", None), (12, 5.0, 0.0, "BOITE", None), (13, 1.0, 10.0, "PTECH", "#FF0000"), (14, 9.0, 10.0, "PTECH", "#00FF00"), (15, 2.0, 20.0, "SITE", None)], "id long, x double, y double, fc_name string, rgb string")
    got = {r["label_id"]: (r["family"], r["target_id"], r["status"]) for r in L.link_labels(labels, targets, [L.Family("fat", "BOITE", 15.0), L.Family("pole", "PTECH", 25.0, "!#FF0000")], 5.0).collect()}
    assert got == {1: ("fat", 12, "selected"), 2: ("pole", 14, "selected"), 3: (None, 15, "linked"), 4: (None, None, "unlinked"), 5: ("fat", None, "outside_tolerance"), 6: (None, 13, "linked")}


def test_repeated_representations_fold(spark):
    rows = [(1, 0.0, 0.0, "block", "A", "L1"), (2, 1.0, 0.0, "circle", "A", None), (3, 50.0, 0.0, "block", "A", "L2")]
    rows += [(4, 900.0, 0.0, "circle", "D", None), (5, 950.0, 0.0, "circle", "D", None)]  # as many as the labelled, far off
    rows += [(6, 52.0, 9.0, "text", "T", None), (7, 800.0, 9.0, "text", "T", ""), (8, 700.0, 0.0, "outline", "S", None)]
    df = spark.createDataFrame(rows, "id long, x double, y double, kind string, layer string, label string")
    got = {r["id"]: (r["disposition"], r["representation"]) for r in L.fold_representations(df, 5.0).collect()}
    assert got[1] == ("kept", "block+circle+text") and got[2][0] == "merged" and got[3] == ("kept", "block+circle+text")
    assert {k: got[k][0] for k in (4, 5, 6, 7, 8)} == {4: "duplicate", 5: "duplicate", 6: "duplicate", 7: "duplicate", 8: "secondary"}
    bare = L.fold_representations(df.withColumn("label", F.lit(None).cast("string")), 5.0)
    assert {r["disposition"] for r in bare.collect()} == {"kept", "merged"}


def test_endpoints_and_nearest_line(spark):
    line = "id long, from_code string, to_code string, points array<struct<x:double,y:double>>"
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    lines = spark.createDataFrame([(1, "a", "B ", p((0, 0), (10, 0))), (2, None, "b", p((0, 0), (10, 0))), (3, "a", "A", p((0, 0), (9, 9))), (4, " ", None, None), (5, "x", "a", p((1, 1)))], line)
    nodes = spark.createDataFrame([("A", 0.0, 1.0), ("b", 10.0, 0.0), (None, 1.0, 1.0)], "code string, x double, y double")
    assert sorted(tuple(r) for r in L.endpoint_coincidence(lines, nodes, 2.0).collect()) == [(2, "null_end", "from"), (3, "off_node", "to"), (3, "self_loop", "both"), (4, "null_end", "both")]
    spans = spark.createDataFrame([(1, p((0, 0), (4, 0))), (2, p((0, 90), (4, 90))), (3, p((100, 0), (200, 0)))], "id long, points array<struct<x:double,y:double>>")
    cables = spark.createDataFrame([(7, p((2, 3), (2, 9))), (8, p((-50, 4), (50, 2))), (9, p((150, -9), (150, 9)))], "id long, points array<struct<x:double,y:double>>")
    got = {r["span_id"]: (r["line_id"], round(r["d"], 3)) for r in L.nearest_line(spans, cables, 5.0).collect()}
    assert got == {1: (8, 2.919), 3: (9, 0.0)}
    assert L.nearest_line(spans.limit(0), cables, 5.0).count() == 0
