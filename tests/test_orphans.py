from datetime import datetime

from pyspark.sql import functions as F

from netloom.functions.keys import ref_key
from netloom import session
from netloom.operators import orphans as O

T = lambda day: datetime(2024, 1, day)


def states(spark, refs, parents):
    p = spark.createDataFrame(parents, "k string, a timestamp, b timestamp, ref_state string")
    r = spark.createDataFrame(refs, "id int, k string, at timestamp, p_key string")
    got = O.classify_references(r, ref_key("k"), F.col("at"), O.presence(p, ref_key("k"), F.col("a"), F.col("b")))
    assert "p_key" in got.columns  # clashing names stay
    return {x["id"]: x["ref_state"] for x in got.collect()}


def test_presence_ties_and_nulls(spark):
    parents = [("A ", T(2), T(5), "x"), ("a", T(4), None, "x"), ("B", T(3), T(3), "x"), (None, T(1), None, "x"), ("C", None, None, "x"), ("D", T(1), T(2), "x"), ("D", T(1), T(2), "x"), ("D", T(6), T(8), "x")]
    refs = [(1, "\ta", T(1), None), (2, "A", T(2), None), (3, "A", T(9), None), (4, "B", T(3), None), (5, "zz", T(3), None), (6, None, T(3), None), (7, " \t ", T(3), None), (8, "D", T(2), None), (9, "d", T(7), None), (10, "D", None, None), (11, "C", T(2), None)]
    got = states(spark, refs, parents)
    assert [got[i] for i in (1, 2, 3, 6, 7, 8, 9, 10)] == ["absent", "present", "present", "none", "none", "absent", "present", "absent"]
    assert all(got[i] in ("never", "absent") for i in (4, 5, 11))


def test_empty_tables(spark):
    assert states(spark, [(1, "A", T(1), None)], []) == {1: "never"}
    assert states(spark, [], [("A", T(1), None, "x")]) == {}


def test_shuffled_path_and_hot_key_match_brute_force(spark, monkeypatch):
    import random

    random.seed(3)
    parents = [(f"K{random.randrange(40)}", T(random.randrange(1, 20)), random.choice([None, T(random.randrange(5, 28))]), "x") for _ in range(120)]
    refs = [(i, "K0" if i % 3 == 0 else f"K{random.randrange(60)}", T(random.randrange(1, 28)), None) for i in range(900)]
    here = lambda k, at: any(p[0] == k and p[1] <= at and (p[2] is None or at < p[2]) for p in parents)
    want = {i: here(k, at) for i, k, at, _ in refs}
    for bound in (session.BROADCAST_BYTES, -1):
        monkeypatch.setattr(session, "BROADCAST_BYTES", bound)
        monkeypatch.setattr(O, "BROADCAST_WORDS", bound)  # the filter joined by a shuffle too
        assert {k: v == "present" for k, v in states(spark, refs, parents).items()} == want
