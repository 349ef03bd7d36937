import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import mixing, topk
from tests.llm.common import edge_docs, edge_rows, no_docs


def brute(codes, queries, k):
    out = []
    for q, c in queries:
        near = sorted((bin((c ^ d) & (1 << 64) - 1).count("1"), i) for i, d in codes if i != q)[:k]
        out += [(q, i, d, n + 1) for n, (d, i) in enumerate(near)]
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("n,k", [(400, 5), (6, 10), (1, 3)])
def test_top_k_equals_brute_force(spark, n, k):
    rng = random.Random(n)
    codes = [(i, signed(rng.getrandbits(64))) for i in range(n)]
    codes += [(1000 + i, codes[0][1]) for i in range(n // 4)]  # one frequent code
    df = spark.createDataFrame([*codes, (None, 5), (2000, None)], "id long, code long")
    queries = [c for c in codes if c[0] % 50 == 0]
    asked = spark.createDataFrame([*queries, queries[0], (7777, None)], "query_id long, code long")
    got = sorted((r.query_id, r.id, r.distance, r.rank) for r in topk.top_k(df, asked, k).collect())
    assert got == brute(codes, queries, k)


def test_top_k_with_crowded_buckets_and_clashing_columns(spark, monkeypatch):
    """A third of the codes share most bits, many queries ask for one bucket, and blocks hold 16 rows."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = random.Random(2)
    codes = [(i, signed(rng.getrandbits(64) & 0xFFFF if i % 3 == 0 else rng.getrandbits(64))) for i in range(600)]
    df = spark.createDataFrame(codes, "id long, code long").withColumns({c: F.lit("clash") for c in ["q", "n", "least", "s", "value", "distance", "rank", "bound", "block"]})
    queries = [c for c in codes if c[0] % 4 == 0]
    asked = df.where("id % 4 = 0").withColumnRenamed("id", "query_id")
    got = sorted((r.query_id, r.id, r.distance, r.rank) for r in topk.top_k(df, asked, 7).collect())
    assert got == brute(codes, queries, 7)


def test_top_k_edges(spark):
    vectors = spark.createDataFrame([([1.0, -1.0, None],), (None,), ([],), ([-0.0, 2.0],)], "v array<double>")
    assert [r[0] for r in vectors.select(topk.sign_code(F.col("v"))).collect()] == [1, None, 0, 2]
    empty = spark.createDataFrame([], "id long, code long")
    assert topk.top_k(empty, empty.withColumnRenamed("id", "query_id")).collect() == []


def weights(tokens, alpha):
    total = sum(tokens.values())
    raw = {s: (t / total) ** alpha for s, t in tokens.items()}
    z = sum(raw.values())
    return {s: r / z for s, r in raw.items()}


def test_mixing_reaches_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    sizes = {"a": 600, "b": 90, "c": 40, None: 25}
    rows = [(1000 * k + i, s, "w " * (1 + (i * 7) % 20)) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed(df, mixing.Mix(repeat_limit=2.5)).collect()
    length = {i: len(t.split()) for i, _, t in rows}
    tokens = {s: sum(length[i] for i, x, _ in rows if x == s) for s in sizes}
    small, big = min(tokens.values()), max(tokens.values())
    alpha = 1 - math.log(2.5) / math.log(big / small)  # the largest repetition is (big / small) ** (1 - alpha)
    want = weights(tokens, alpha)
    budget = big / want["a"]
    for s, t in tokens.items():
        mine = [r for r in got if r.source == s]
        assert abs(mine[0].weight - want[s]) < 1e-5
        assert 0 <= want[s] * budget + 1 - sum(r.n_tokens for r in mine) <= 21  # less than a document short
        full = int(want[s] * budget / t + 1e-6)
        blocks = {b: sorted(r.doc_id for r in mine if r.block == b) for b in {r.block for r in mine}}
        every = sorted(i for i, x, _ in rows if x == s)
        assert all(blocks[b] == every for b in range(full)) and set(blocks) <= set(range(full + 1))
        # the last block is the start of a permutation: the next document would not fit
        if full in blocks:
            left = want[s] * budget - full * t
            assert sum(length[i] for i in blocks[full]) <= left + 1
    assert len({r.doc_id for r in got}) == len(rows)


def test_mixing_by_entropy_and_budget(spark):
    rows = [(i, "a" if i % 10 else "b", "w " * 10) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed(df, mixing.Mix(entropy=0.6, budget=2000)).collect()
    share = {s: next(r.weight for r in got if r.source == s) for s in "ab"}
    assert abs(-sum(w * math.log(w) for w in share.values()) - 0.6) < 1e-5
    assert 1970 <= sum(r.n_tokens for r in got) <= 2001


def test_mixing_edges(spark):
    got = mixing.mixed(edge_docs(spark)).collect()
    assert {r.doc_id for r in got} == {r[0] for r in edge_rows()}
    assert sum(r.doc_id == 1 and r.block == 0 for r in got) == 2
    rows = mixing.mixed_rows(edge_docs(spark))
    assert rows.columns == edge_docs(spark).columns and rows.count() == len(got)
    assert {(r.row_hash, r.place, r.block) for r in rows.collect()} == {("clash", "clash", "clash")}
    assert mixing.mixed(no_docs(spark)).collect() == []
    blank = spark.createDataFrame([(1, "a", None), (2, "a", " ")], "doc_id long, source string, text string")
    assert sorted(r.doc_id for r in mixing.mixed(blank).collect()) == [1, 2]
