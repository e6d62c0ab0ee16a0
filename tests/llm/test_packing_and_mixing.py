import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import mixing as M
from netloom.llm import packing as P
from netloom.llm.tokens import TOKENIZERS, VOCABULARY, encoder, token_counts


def test_bounds_are_optimal():
    hist = {2: 5, 3: 1, 7: 4, 8: 9, 15: 2, 16: 1, 30: 3}
    pad = lambda bounds: sum(n * (min(b for b in bounds if b >= s) - s) for s, n in hist.items())
    for k in (1, 2, 3, 4, 7, 9):
        got = P.bucket_bounds(hist, k)
        best = min(pad((*c, 30)) for c in itertools.combinations(sorted(hist)[:-1], min(k, 7) - 1))
        assert len(got) <= k and pad(got) == best


@pytest.mark.parametrize("capacity", [64, 100])
def test_pack(spark, capacity):
    random.seed(capacity)
    sizes = [random.choice([0, 1, 5, 5, 5, 20, 33, 50, 51, capacity, capacity + 1, 3 * capacity + 7]) for _ in range(700)]
    rows = [(i, n) for i, n in enumerate(sizes)] + [(5, 20), (5, 20), (None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").repartition(5)
    out, fig = P.pack(df, "doc_id", capacity, buckets=6)
    got = out.collect()
    fill = Counter()
    for r in got:
        fill[r["container_id"]] += r["n_tokens"]
        assert r["n_tokens"] <= max(r["bucket"], 0)
    assert max(fill.values()) <= capacity and sum(fill.values()) == sum(n for _, n in rows)
    whole = Counter()
    for r in got:
        whole[r["doc_id"]] += r["n_tokens"]
        assert r["tok_start"] == r["piece_no"] * capacity
    want = Counter()
    for i, n in rows:
        want[i] += n
    assert whole == want and len(got) == sum(max(1, -(-n // capacity)) for _, n in rows)
    assert {r["doc_id"] for r in got if r["piece_no"]} == {i for i, n in rows if n > capacity}
    assert fig["containers"] == len({c for c in fill if fill[c]}) and fig["fill_share"] >= fig["fill_share_one_bucket"]


def test_pack_empty(spark):
    out, fig = P.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), "doc_id", 10)
    assert out.count() == 0 and fig["containers"] == 0
    out, fig = P.pack(spark.createDataFrame([(1, 0)], "doc_id long, n_tokens long"), "doc_id", 10)
    assert out.first()["container_id"] == 0


def test_token_counts(spark):
    enc = encoder(f"{TOKENIZERS}/{VOCABULARY}")
    texts = ["Hello world, it's 2024!", None, "", "<|endoftext|>", "a " * 40_000, "电杆 12"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert enc.decode(enc.encode_ordinary(texts[5])) == texts[5]


def docs(spark, n=1200):
    random.seed(4)
    rows = [(i, "big" if i % 3 == 0 else random.choice(["a", "b", "tiny", None, "odd"]), random.choice([0, 3, 40, 90, 700])) for i in range(n)]
    rows = [(i, "b" if s == "tiny" and i % 7 else s, t) for i, s, t in rows]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(M, "SEGMENT", 100)
    rows, df = docs(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("a", 0.2, 2), ("b", 0.2, 2), ("tiny", 0.05, 4), ("gone", 0.05, 3), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed = M.mix(df, targets, block=64).collect()
    size = {i: t for i, _, t in rows}
    source = {i: s for i, s, _ in rows}
    blocks = Counter((r["source"], r["block"], r["repetition"]) for r in mixed)
    uses = Counter()
    for r in mixed:
        assert source[r["doc_id"]] == r["source"] and 0 <= r["tok_start"] < r["tok_end"] <= size[r["doc_id"]]
        uses[(r["source"], r["doc_id"], r["tok_start"], r["tok_end"])] += 1
    limit = {"big": 1, "a": 2, "b": 2, "tiny": 4}
    assert all(n <= limit[k[0]] for k, n in uses.items()) and set(k[0] for k in blocks) == set(limit)
    total = sum(r["tok_end"] - r["tok_start"] for r in mixed)
    for s, share in (("big", 0.5), ("a", 0.2), ("b", 0.2), ("tiny", 0.05)):
        got = sum(r["tok_end"] - r["tok_start"] for r in mixed if r["source"] == s) / total
        assert abs(got - share / 0.95) < 0.01
    again = M.mix(df.repartition(7), targets, block=64)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed))
    rep = {r["source"]: r for r in M.shares(again, targets.where("source IS NOT NULL")).collect()}
    assert rep["gone"]["tokens"] == 0 and abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-9
    assert sum(r["tokens"] for r in rep.values()) == total and rep["big"]["most_uses"] == 1


def test_mix_empty(spark):
    _, df = docs(spark, 10)
    targets = spark.createDataFrame([("none", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert M.mix(df, targets).count() == 0
    assert M.mix(df.where(F.lit(False)), targets).count() == 0


def test_blocks_hold_every_token_once(spark):
    rows, df = docs(spark)
    parts = M.blocks(df.where("source IS NOT NULL"), 64, 3).collect()
    per_doc, per_block = Counter(), Counter()
    for r in parts:
        per_doc[r["doc_id"]] += r["tok_end"] - r["tok_start"]
        per_block[r["source"], r["block"]] += r["tok_end"] - r["tok_start"]
    assert per_doc == Counter({i: t for i, s, t in rows if s and t}) and max(per_block.values()) == 64
    assert all(n == 64 for (s, b), n in per_block.items() if (s, b + 1) in per_block)


def test_permutation_and_draws():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(M.permuted(np.arange(n), n, 99).tolist()) == list(range(n))
    big = M.permuted(np.arange(1000) + 10**13, 3 * 10**13, 5)  # far beyond what a product of two indices could hold
    assert len(set(big.tolist())) == 1000 and big.min() >= 0 and big.max() < 3 * 10**13
    rng = np.random.default_rng(1)
    for good, bad, sample in ((5, 7, 6), (300, 40, 90), (10**12, 3 * 10**12, 10**9)):
        got = [M.hypergeometric(good, bad, sample, rng) for _ in range(3000)]
        p = good / (good + bad)
        sd = (sample * p * (1 - p) * (good + bad - sample) / (good + bad - 1)) ** 0.5
        assert max(0, sample - bad) <= min(got) and max(got) <= min(good, sample)
        assert abs(np.mean(got) - sample * p) < 5 * sd / 3000**0.5 and 0.9 < np.std(got) / sd < 1.1
    assert M.hypergeometric(0, 5, 3, rng) == 0 and M.hypergeometric(4, 0, 3, rng) == 3 and M.hypergeometric(4, 2, 6, rng) == 4


def test_large_tables_keep_their_texts_where_they_are(spark):
    df = spark.range(64, numPartitions=16).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    assert "Exchange" not in token_counts(df, parts=16)._jdf.queryExecution().executedPlan().toString()
