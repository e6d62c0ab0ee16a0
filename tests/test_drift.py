import json
from datetime import datetime

from netloom import session
from netloom.operators import drift as D
from netloom.plans.p5_drift import BOX_CODE

T = lambda day: datetime(2024, 1, day)
SCHEMA = "raw_id long, series string, file_id long, delivered_at timestamp, line_no int, record string, path string"


def lines(files):
    out = []
    for series, file_id, day, objs in files:
        for k, o in enumerate(objs):
            out.append((len(out), series, file_id, T(day), k, o if isinstance(o, str) or o is None else json.dumps(o), "clash"))
    return out


def boxes(code="CODE", **extra):
    return [{code: f"PBO-ABC-{i:03d}", **{k: (v(i) if callable(v) else v) for k, v in extra.items()}} for i in range(6)]


def test_scripts(spark):
    files = [
        ("s", 5, 1, [*boxes(A=lambda i: i, B="x", N=lambda i: {"u": i, "w": "q"}), None, "[1]", '{"CODE": "PBO-A', "", "7"]),
        ("s", 3, 2, boxes(A2=lambda i: i, B="x", N=lambda i: {"u": i, "w": "q"})),  # A renamed
        ("s", 9, 3, [*boxes("ID", A2=lambda i: float(i), N=lambda i: {"u": i, "w2": "q"}, EXTRA=1), *boxes("ID", A2=lambda i: float(i), N=None, EXTRA=None)]),  # key renamed, type, B gone, nested rename
        ("s", 4, 4, ["{}", "nonsense"]),  # no whole line with fields
        ("t", 1, 1, boxes(P=lambda i: i % 2 == 0)),
        ("t", 2, 2, boxes(Q=lambda i: i % 3 == 0, R=lambda i: str(i % 2 == 0))),  # values don't agree, or only in another type
    ]
    got = {tuple(r) for r in D.drift_events(spark.createDataFrame(lines(files), SCHEMA), BOX_CODE).collect()}
    sep = D.SEP
    want = {(3, "A2", "renamed", "A"), (9, "ID", "renamed", "CODE"), (9, "A2", "type", ""), (9, "B", "removed", ""), (9, "EXTRA", "added", ""), (9, f"N{sep}w2", "renamed", f"N{sep}w")}
    want |= {(4, f, "removed", "") for f in ("ID", "A2", "EXTRA", "N", f"N{sep}u", f"N{sep}w2")}
    want |= {(2, "P", "removed", ""), (2, "Q", "added", ""), (2, "R", "added", "")}
    assert got == want


def test_moves_and_assignment():
    sep = D.SEP
    got = D.edit_script({"a": "object", f"a{sep}k": "int", "b": "object"}, {"a": "object", "b": "object", f"b{sep}k": "int"}, {(f"a{sep}k", f"b{sep}k"): (4, 4)})
    assert got == [("moved", f"b{sep}k", f"a{sep}k")]
    assert D.assign([[4, 1, 3], [2, 0, 5], [3, 2, 2]]) == [1, 0, 2]


def test_empty_and_shuffled_path(spark, monkeypatch):
    assert D.drift_events(spark.createDataFrame([], SCHEMA), BOX_CODE).count() == 0
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    raw = spark.createDataFrame(lines([("s", 1, 1, boxes(A=1)), ("s", 2, 2, boxes(B=1))]), SCHEMA)
    assert [tuple(r) for r in D.drift_events(raw, BOX_CODE).collect()] == [(2, "B", "renamed", "A")]


def test_consistent_table(spark):
    files = [("s", 1, 1, boxes(x=lambda i: f"{i},5", odd=1)), ("s", 2, 2, boxes("ID", X=lambda i: i + 0.5, odd=1)), ("s", 3, 3, boxes("ID", Y2=lambda i: i + 0.5)), ("u", 7, 1, [*boxes("ID", X=1.0), "{broken"])]
    raw = spark.createDataFrame(lines(files), SCHEMA)
    names = D.lineages(raw, D.drift_events(raw, BOX_CODE), ["CODE", "X"])
    t = D.consistent_table(raw, names, {"CODE": "string", "X": "double"}).collect()
    assert len(t) == 24 and all(r["code"].startswith("PBO-ABC") for r in t)
    assert sorted(r["x"] for r in t if r["file_id"] in (2, 3)) == sorted([i + 0.5 for i in range(6)] * 2)
    # the first file's x is another type, so it is another field: removed and added, not renamed
    assert {r["x"] for r in t if r["file_id"] == 1} == {None} and all(set(r["more"]) == {"odd", "x"} for r in t if r["file_id"] == 1)


def test_every_field_of_a_clash_has_a_place(spark):
    half, triple = (lambda i: i + 0.5), (lambda i: i * 3.0)
    files = [("s", 1, 1, boxes(X=half)), ("s", 2, 2, boxes(xx=half)), ("w", 4, 1, boxes(X=half)), ("w", 5, 2, boxes(A1=half))]  # xx and A1 lead to X
    files += [("t", 3, 1, boxes(X=half, xx=triple)), ("v", 6, 1, boxes(A1=triple, X=half, xx=lambda i: i))]
    raw = spark.createDataFrame(lines(files), SCHEMA)
    names = D.lineages(raw, D.drift_events(raw, BOX_CODE), ["CODE", "X"])
    got = {(r["file_id"], r["line_no"]): (r["x"], r["more"]) for r in D.consistent_table(raw, names, {"CODE": "string", "X": "double"}).collect()}
    assert all(got[f, i] == (i + 0.5, {}) for f in (1, 2, 4, 5) for i in range(6))
    assert all(got[3, i] == (i + 0.5, {"xx": str(i * 3.0)}) for i in range(6))
    assert all(got[6, i] == (i + 0.5, {"A1": str(i * 3.0), "xx": str(i)}) for i in range(6))


def test_places():
    # X loses CODE and stands in `more`, so q can have the column X; b loses to a's own name, so c can't have b's
    fields = [("CODE", "CODE", 0), ("X", "CODE", 1), ("q", "X", 2), ("a", "a", 0), ("b", "a", 3), ("c", "b", 3)]
    assert D.places(fields, {"CODE", "X"}) == ({"CODE": "CODE", "X": "q"}, {"X": "X", "a": "a", "b": "b", "c": "c"})


def test_repeated_keys_and_nested_fields_stay(spark):
    files = [("s", 1, 1, ['{"CODE": "PBO-ABC-1", "X": 1, "X": 2.50, "a": {"k": "v", "n": null}, "l": [1, 2.5]}', '{"CODE": "PBO-ABC-2"', "[1]", "null"])]
    raw = spark.createDataFrame(lines(files), SCHEMA)
    names = D.lineages(raw, D.drift_events(raw, BOX_CODE), ["CODE", "X"])
    (r,) = D.consistent_table(raw, names, {"CODE": "string", "X": "double"}).collect()
    assert (r["code"], r["x"]) == ("PBO-ABC-1", 2.5) and r["more"] == {f"a{D.SEP}k": "v", f"a{D.SEP}n": None, "l": "[1, 2.5]"}
    assert D.field_texts('{"X": 12.50, "Y": true, "Z": 7, "E": {}}') == {"X": "12.50", "Y": "true", "Z": "7", "E": "{}"}
