import random

from netloom import session
from netloom.llm import vocabulary as V

VOC = [("t", "BPE", "boîtier de protection d'épissures", "splice closure"), ("t", "PBO", "point de branchement optique", "optical drop point"), ("t", "PTO", "prise terminale optique", None), ("s", "EN PROJET", "à l'état de projet", "planned"), ("s", "DEPLOYE", "déployé et en service", "deployed"), ("s", "EN COURS DE DEPLOIEMENT", "chantier en cours", "work in progress")]
WANT = {
    ("t", "pbo"): "PBO", ("t", "P B O"): "PBO", ("t", "P.B.O"): "PBO", ("t", "PB0"): "PBO", ("t", "РВО"): "PBO", ("t", "ＰＢＯ"): "PBO", ("t", "Pboo"): "PBO", ("t", " PBO 8 FO"): "PBO", ("t", "OPTICA LDROP POINT"): "PBO",
    ("t", "BOITIERDE PROTECTION D EPISURES"): "BPE", ("t", "SPLIEC CLOSURE"): "BPE", ("t", "prise pto"): "PTO", ("t", "voir fiche"): "UNMATCHED", ("t", "4412"): "UNMATCHED", ("t", "?"): "UNMATCHED", ("t", "coupleur 1:8"): "UNMATCHED",
    ("s", "en cours"): "EN COURS DE DEPLOIEMENT", ("s", "DEPL."): "DEPLOYE", ("s", "enc. de deploiement"): "EN COURS DE DEPLOIEMENT", ("s", "WORKIN PROGRES"): "EN COURS DE DEPLOIEMENT", ("s", "proj"): "EN PROJET", ("s", "A VERIFIER"): "UNMATCHED", ("s", "litige"): "UNMATCHED", ("none", "PBO"): "UNMATCHED",
}


def rows(spark):
    r = [(f, i, v, "c") for i, (f, v) in enumerate(WANT)]
    r += [("t", 100, None, "c"), ("t", 101, "  ", "c"), ("t", 102, "", "c"), ("t", 103, "PBO", "c"), ("t", 104, "pbo", "c"), ("t", 105, "z" * 20_000, "c")]
    return spark.createDataFrame(r, "field_name string, id long, value string, canon_value string").select("field_name", "id", "value")


def test_map_rows(spark, monkeypatch):
    voc = spark.createDataFrame(VOC, "field_name string, canon_value string, a string, b string")
    want = {i: c for i, c in enumerate(WANT.values())} | {104: "PBO", 105: "UNMATCHED"}
    for bound in (session.BROADCAST_BYTES, -1):
        monkeypatch.setattr(session, "BROADCAST_BYTES", bound)
        got = {r["id"]: r["canon_value"] for r in V.map_rows(rows(spark), voc, ["canon_value", "a", "b"]).collect()}
        assert got == want


def test_empty(spark):
    voc = spark.createDataFrame(VOC, "field_name string, canon_value string, a string, b string")
    assert V.map_rows(rows(spark).limit(0), voc, ["canon_value", "a", "b"]).count() == 0
    assert {r["canon_value"] for r in V.map_rows(rows(spark), voc.limit(0), ["canon_value"]).collect()} == {"UNMATCHED"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_no_pair_within_the_room_is_lost(spark):
    random.seed(12)
    refs = ["AAABBBCCCCDDD", "INFRASTRUCTURE", "PBO", "SPLICE", "BRANCHEMENT", "DEPLOIEMENTS", "RACCORDEMENTOPTIQUE", "GHIJ", "मास्टर", "光缆交接箱"]
    words = {"XAAABBYBCCCCDDZD", "INFRXSTRYCTUZE", "X" * 40}
    for r in refs:
        for k in range(5):
            for _ in range(6):
                w = list(r)
                for _ in range(k):
                    at, how = random.randrange(len(w) + 1), random.randrange(3)
                    w[at : at + (how > 0)] = [] if how == 1 else [random.choice("ABCDEXYZ")]
                words.add("".join(w))
    words.discard("")
    got = {(r["token"], r["ref"]) for r in V.repairs(spark.createDataFrame([("f", w) for w in words], "field_name string, token string"), spark.createDataFrame([("f", r) for r in refs], "field_name string, ref string")).collect()}
    room = lambda n: 0 if n <= 2 else 1 if n <= 5 else 2 if n <= 12 else 3
    want = {(w, r) for w in words for r in refs if distance(w, r) <= room(max(len(w), len(r)))}
    assert want <= got and ("XAAABBYBCCCCDDZD", "AAABBBCCCCDDD") in got and ("INFRXSTRYCTUZE", "INFRASTRUCTURE") in got
    pairs = {(r["a"], r["b"]) for r in V.alike_pairs(spark.createDataFrame([("f", w) for w in words], "field_name string, a string"), spark.createDataFrame([("f", r) for r in refs], "field_name string, b string")).collect()}
    assert {(w, r) for w in words for r in refs if len(r) > 3 and 1 - distance(w, r) / max(len(w), len(r)) >= V.ACCEPT_WHOLE} <= pairs


def test_other_scripts(spark):
    voc = spark.createDataFrame([("t", "MAST", "电杆安装点", "опора линии"), ("t", "BOX", "光缆交接箱", "शाखा बॉक्स")], "field_name string, canon_value string, a string, b string")
    rows = spark.createDataFrame([("t", 1, "电杆安装"), ("t", 2, "опора лини"), ("t", 3, "शाखा बॉक्"), ("t", 4, "ОПОРА"), ("t", 5, "水")], "field_name string, id long, value string")
    assert {r["id"]: r["canon_value"] for r in V.map_rows(rows, voc, ["canon_value", "a", "b"]).collect()} == {1: "MAST", 2: "MAST", 3: "BOX", 4: "MAST", 5: "UNMATCHED"}
