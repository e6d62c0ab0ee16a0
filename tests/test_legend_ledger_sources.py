import json

import pytest
from pyspark.sql import functions as F

from netloom.operators import aggregates as A
from netloom.operators.legend import confirmed, legend_clusters
from netloom.sources import drawings as S
from netloom.sources import sinks as K

F4 = "id string, x double, y double, text string"


def body():
    return [(f"body-{i}", 500000.0 + (i % 20) * 100, 60000.0 + (i // 20) * 100, None) for i in range(200)]


def legend():
    texts = {0: "LEGENDA", 1: "CABLE TYPE"}
    return [(f"legend-{j}", 504900.0 + (j % 2) * 40, 60300.0 + (j // 2) * 30, texts.get(j)) for j in range(12)]


def test_legend_detection(spark):
    f = spark.createDataFrame(body() + legend(), F4)
    clusters, members = legend_clusters(f)
    (c,) = clusters.collect()
    assert c["cluster"] == "LC-001" and c["members"] == 12 and c["axes"] == "x" and set(c["anchors"]) == {"LEGENDA", "CABLE TYPE"} and c["confidence"] > 0.9
    assert {r["id"] for r in members.collect()} == {f"legend-{j}" for j in range(12)}
    assert confirmed(members, f, [], []).first()["confirmed"] is False
    assert confirmed(members, f, [(504000.0, 60000.0, 506000.0, 61000.0)], []).first()["confirmed"]
    assert confirmed(members, f, [], [f"legend-{j}" for j in range(11)]).first()["confirmed"]


def test_legend_diagonal_none_and_tiny(spark):
    diag = [(f"d-{j}", 497000.0 + (j % 2) * 40, 57000.0 + (j // 2) * 30, None) for j in range(6)]
    (c,) = legend_clusters(spark.createDataFrame(body() + diag, F4))[0].collect()
    assert c["members"] == 6 and c["axes"] == "x,y"
    assert legend_clusters(spark.createDataFrame(body(), F4))[0].count() == 0
    assert legend_clusters(spark.createDataFrame(body()[:5], F4))[0].count() == 0


def test_ledger_round_trip(spark, tmp_path):
    rows = [("mapped", "FAT", 40), ("mapped", "KU KABEL 12", 25), ("annotation_consumed", "TEXT NAMA JALAN", 20), ("out_of_scope", "0", 10), ("legend", "LEGENDA", 5)]
    ledger = spark.createDataFrame(rows, "disposition string, layer string, n long")
    assert A.conservation_check(ledger, 100).first()["ok"] and not A.conservation_check(ledger, 101).first()["ok"]
    for _ in range(2):
        assert K.write_evidence(f"{tmp_path}/e", ledger, 100)
    assert K.read_table(spark, f"{tmp_path}/e/conservation_ledger").count() == 6
    with pytest.raises(ValueError):
        K.write_evidence(f"{tmp_path}/e", ledger, 101, strict=True)
    assert not K.write_evidence(f"{tmp_path}/e", ledger, 101)
    assert K.read_table(spark, f"{tmp_path}/no_such_table") is None


def test_drawing_dump(spark, tmp_path):
    objs = [
        {"object": "LTYPE", "name": "ByLayer", "handle": [0, 1, 1]},
        {"object": "LTYPE", "name": "DASHED", "handle": [0, 1, 2]},
        {"object": "LAYER", "name": "FAT", "handle": [0, 1, 3], "color": {"rgb": 0xC3000005, "index": 256}, "ltype": [5, 1, 2]},
        {"object": "LAYER", "name": "0", "handle": [0, 1, 4], "color": {"rgb": 0, "index": 300}, "ltype": [5, 1, 1]},
        {"object": "LAYOUT", "layout_name": "FDT-ALL", "tab_order": 1, "handle": [0, 1, 5], "block_header": [4, 1, 6]},
        {"object": "BLOCK_HEADER", "handle": [0, 1, 6], "entities": [[3, 1, 7], [3, 1, 8]]},
        {"entity": "TEXT", "handle": [0, 1, 7], "text_value": "hello"},
        {"entity": "INSERT", "handle": [0, 1, 8], "name": "BLK", "attribs": [[3, 1, 9], [3, 1, 10]]},
        {"entity": "ATTRIB", "handle": [0, 1, 9], "tag": "fdt_id", "text_value": "FDT-01"},
        {"entity": "ATTRIB", "handle": [0, 1, 10], "tag": "FAT_SEQUENCE", "text_value": "A1"},
    ]
    (tmp_path / "d.json").write_text(json.dumps({"OBJECTS": objs}))
    o = S.objects(spark, str(tmp_path / "d.json"))
    assert {(r["layer"], r["aci"], r["linetype"]) for r in S.layer_table(o).collect()} == {("FAT", 5, "DASHED"), ("0", 7, "Continuous")}
    e = S.layout_entities(o)
    assert {(r["entity"], r["text"]) for r in e.collect()} == {("TEXT", "hello"), ("INSERT", None)}
    (f,) = S.layout_facts(e).collect()
    assert f["ids"] == ["FDT-01"] and f["sequences"] == ["A1"] and f["usable"]
    ports = S.dispositions(spark.createDataFrame([("LINE", 2), ("LINE", 0), ("LINE", 1), ("BLOCK", 2), ("HATCH", 2), ("DIMENSION_LINEAR", 2)], "entity string, entmode int"))
    assert [r["port"] for r in ports.collect()] == [None, "block_definition", "paper_space", "control_entity", "unsupported_type:HATCH", "dimension"]


def test_settings_vocabulary_reports_and_exports(spark, tmp_path):
    (tmp_path / "v.csv").write_text("bpe;x\nPBO;y\n bpe ;z\n;\n")
    assert [r["value"] for r in S.vocabulary(spark, str(tmp_path / "v.csv"), []).collect()] == ["BPE", "PBO"]
    assert [r["value"] for r in S.vocabulary(spark, str(tmp_path / "none.csv"), ["a", "b", "a"]).collect()] == ["A", "B"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r/one.json").write_text('{"a": 1}')
    (tmp_path / "r/two.json").write_text("{")
    assert {r["name"]: r["body"] is None for r in S.reports(spark, str(tmp_path / "r")).collect()} == {"one": False, "two": True}
    assert S.json_settings(str(tmp_path / "r/two.json"), {"d": 1}) == {"d": 1} and S.json_settings(str(tmp_path / "r/one.json"), {}) == {"a": 1}
    c = S.EngineConfig(vocabularies={"T": ["A"]}, patterns=(("x", "B"),)).overlay({"snap": 7.0, "patterns": [["y", "C"]], "vocabularies": {"T": ["B"]}, "odd": 1})
    assert c.snap == 7.0 and c.patterns == (("y", "C"), ("x", "B")) and c.vocabularies == {"T": ["A", "B"]}
    df = spark.createDataFrame([("BOITE", 1, [1, 2]), ("SITE", 2, None)], "fc_name string, id int, a array<int>")
    K.write_layers(df, f"{tmp_path}/layers")
    assert spark.read.parquet(f"{tmp_path}/layers").count() == 2
    assert K.export_sqlite(df, f"{tmp_path}/x.sqlite", "t") == 2 and K.export_sqlite(df, f"{tmp_path}/x.sqlite", "t") == 2
    h = spark.createDataFrame([("BOITE", '#FF0000|"Dash"', "255,0,0,255", 3), ("BOITE", "b", "0,0,0,255", 5)], "layer string, style_key string, rgba string, n int")
    assert K.write_styles(h, f"{tmp_path}/s")["BOITE"]["categories"] == 2
    rules = spark.createDataFrame([("1.1", "C", "PASS", 0, 8)], "rule_id string, severity string, status string, n_violations int, n_evidence int")
    assert json.loads(K.report_json(rules, A.verdict(rules)))["summary"]["verdict"] == "PASS"


def test_stream_of_deliveries(spark, tmp_path):
    from netloom.streaming.deliveries import counts_by_window, read_deliveries

    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, 0, id * 20) AS ts, CAST(id % 2 AS STRING) AS k FROM range(12)")
    rows.write.parquet(f"{tmp_path}/in")
    q = counts_by_window(read_deliveries(spark, f"{tmp_path}/in", "ts timestamp, k string"), "ts", ["k"]).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in counts_by_window(rows, "ts", ["k"]).collect()}
    assert {tuple(r) for r in spark.table("w").collect()} == want and sum(r[2] for r in want) == 12
    assert rows.agg(F.count("*")).first()[0] == 12
