"""Periodic runs against a comparison of every period; edge rows; the planted tails."""

import hashlib
import random
import zlib
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import periodic

from .common import edge_docs, edge_rows, no_docs, words


def brute(words, least, periods):
    n, out = len(words), set()
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, periods * q):
                w = words[i : i + length]
                if not any(w[d:] == w[:-d] for d in range(1, q)):
                    out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 5), st.integers(0, 90), st.sampled_from([(1, 2), (6, 2), (24, 3), (8, 3), (1, 3), (10, 4)]))
def test_runs_equal_all_periods(seed, letters, n, asked):
    rng = random.Random(seed)
    w = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 4:
            a, p, size = rng.randrange(n), rng.randint(1, 12), rng.randint(1, 60)
            for i in range(a + p, min(n, a + p + size)):
                w[i] = w[i - p]
    assert periodic.runs(w, *asked) == brute(w, *asked)


def test_trees_alone_find_the_same():
    rng = random.Random(3)
    for _ in range(200):
        w = [rng.randrange(3) for _ in range(rng.randint(2, 60))]
        assert periodic.runs_in(w, 2, 2) == brute(w, 2, 2)


def test_long_repetitions_and_repeated_passages():
    rng = random.Random(4)
    passage = words(rng, 80).encode().split()
    text = passage + words(rng, 500).encode().split() + passage  # a passage twice is no run of three periods
    assert periodic.runs(text) == [] and periodic.chains(text, 24, 3) == []
    assert periodic.runs([b"a"] * 30000) == [(0, 30000, 1)]
    unit = [str(i).encode() for i in range(5000)]
    assert periodic.runs([b"x", *unit * 4, b"y"]) == [(1, 20000, 5000)]


def planted(ident, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(ident).encode()), len(w)
    if ident is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def row(ident, text):
    w = planted(ident, text)
    found = brute(w, 24, 3) if len(w) < 2000 else periodic.runs(w)
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s).hexdigest()
    numbers = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return ident, len(found), *numbers, sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))


def test_query_equals_plain_version(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randint(0, 200))) for i in range(150)]
    rows += [(1000 + i, " ".join([words(rng, rng.randint(1, 9))] * rng.randint(2, 9)) + "\n" + words(rng, 5)) for i in range(60)]
    rows += [(r[0], r[1]) for r in edge_rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = periodic.periodic_runs(df, change=periodic.tail_repeated).drop("runs")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((row(*r) for r in rows), key=str)
    assert sum(r["n_runs"] > 0 for r in got.collect()) > 20


def test_edges(spark):
    assert periodic.periodic_runs(edge_docs(spark)).count() == len(edge_rows())
    assert periodic.periodic_runs(no_docs(spark)).count() == 0
    one = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert periodic.periodic_runs(one).first()["runs"] == "0,40,2\n"
    assert periodic.strongest([(5, 30, 10), (0, 24, 8), (9, 60, 20)]) == (5, 30, 10)
