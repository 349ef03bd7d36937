import random

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import components, simhash
from tests.llm.common import edge_docs, edge_rows, no_docs, words


def slow_print(text, width=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def slow_groups(ids, prints, most=3):
    codes = np.array(prints, np.int64).view(np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(codes[i] ^ codes) <= most):
            root[find(int(j))] = find(i)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


@pytest.mark.parametrize("bucket", [512, 8])
def test_groups_equal_brute_force(spark, bucket):
    rng = random.Random(2)
    prints = []
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(8):
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    ball = rng.getrandbits(64)  # one dense group, far over the small bucket
    for _ in range(300):
        y = ball
        for p in rng.sample([1, 2, 3, 5, 7, 40, 41, 50, 61], rng.randint(0, 6)):
            y ^= 1 << p
        prints.append(y)
    prints = [p - (1 << 64) if p >> 63 else p for p in [*prints, 0, 0]]
    ids = [(i * 7919) % 100_003 for i in range(len(prints))]
    df = spark.createDataFrame(list(zip(ids, prints)), "doc_id long, fingerprint long")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df, 3, bucket).collect()}
    assert got == dict(zip(ids, slow_groups(ids, prints)))


def test_edges(spark):
    rows = edge_rows()
    want = sorted(zip([r[0] for r in rows], [slow_print(r[1]) for r in rows]), key=repr)
    prints = simhash.materialized_fingerprints(edge_docs(spark))
    assert sorted(((r.doc_id, r.fingerprint) for r in prints.collect()), key=repr) == want
    groups = sorted(((r.doc_id, r.component_id) for r in simhash.near_groups(prints).collect()), key=repr)
    assert groups == sorted(zip([w[0] for w in want], slow_groups([w[0] for w in want], [w[1] for w in want])), key=repr)
    assert simhash.near_groups(simhash.materialized_fingerprints(no_docs(spark))).collect() == []
    with pytest.raises(ValueError):
        simhash.links(prints.withColumnRenamed("fingerprint", "fp"), 4)


def test_keep_one(spark):
    rng = random.Random(8)
    base = [words(rng, 150) for _ in range(30)]
    rows = []
    for k, text in enumerate(base):
        w = text.split()
        w[40], w[90] = "changed", "twice"  # 10 of about 146 shingles differ: 0.87 alike
        rows += [(3 * k, text, k), (3 * k + 1, " ".join(w), k)] + [(3 * k + 2, text, k)] * (k % 2)
    alone = [(1000 + i, words(rng, 150), 100 + i) for i in range(40)]
    df = spark.createDataFrame(rows + alone, "doc_id long, text string, fp int")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    got = sorted(r.doc_id for r in out.collect())
    assert [x for x in got if x >= 1000] == [a[0] for a in alone]
    kept = [x for x in got if x < 1000]
    assert set(range(0, 90, 3)) <= set(kept) and len(kept) <= 33
    edges = simhash.keep_one(edge_docs(spark)).collect()
    assert sum(r.doc_id == 1 for r in edges) == 1 and sorted(r.doc_id for r in edges if not (r.text or "").strip()) == [2]
    assert simhash.keep_one(no_docs(spark)).collect() == []


def test_keep_one_takes_candidates_from_simhashes(spark, monkeypatch):
    """Near copies within 3 bits go by their SimHashes alone; the finer signatures only add to them."""
    rng = random.Random(9)
    rows = []
    for k in range(20):
        w = words(rng, 1500).split()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:700], "changed", *w[701:]]))]
    prints = [np.uint64(simhash.fingerprint(text) & (1 << 64) - 1) for _, text in rows]
    close = [k for k in range(20) if np.bitwise_count(prints[2 * k] ^ prints[2 * k + 1]) <= 3]
    assert len(close) > 10
    monkeypatch.setattr(simhash, "_members", lambda marks, level: marks.selectExpr("0L band", "node").where("false"))
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i, _ in rows} - {2 * k + 1 for k in close}


def edited(rng, w, kind, share):
    """A copy of the words that differs in one of the ways that texts do."""
    n = round(len(w) * share)
    if kind == "appended":
        return w + words(rng, n).split()
    if kind == "cut":
        return w[: len(w) - n]
    if kind == "block":
        at = rng.randrange(len(w) - n)
        return w[:at] + words(rng, n).split() + w[at + n :]
    out = list(w)
    for at in rng.sample(range(len(w)), max(1, n // 5)):
        out[at] = "changed%d" % at
    return out


def test_pairs_of_edited_copies_equal_brute_force(spark):
    rng = random.Random(12)
    texts = []
    for kind in ("appended", "cut", "block", "scattered"):
        for k in range(100):
            w = words(rng, rng.randint(120, 400)).split()
            texts += [" ".join(w), " ".join(edited(rng, w, kind, rng.choice((0.04, 0.07, 0.09, 0.1, 0.15, 0.17, 0.2))))]
    real = {(2 * k + 1, 2 * k) for k in range(len(texts) // 2) if 0.8 <= simhash._jaccard(texts[2 * k], texts[2 * k + 1], 5) < 1}
    assert len(real) > 200 and all(sum(100 * q <= a // 2 < 100 * q + 100 for a, _ in real) > 40 for q in range(4))
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(8)
    assert {(r.a, r.b) for r in simhash.similar_pairs(df).collect()} == real


@pytest.mark.parametrize("block, crowd", [(256, 2048), (16, 2048), (256, 8)])
def test_pairs_in_a_crowd_of_templates_equal_brute_force(spark, monkeypatch, block, crowd):
    monkeypatch.setattr(simhash._cells, "__defaults__", (block,))
    rng = random.Random(5)
    parts = [words(rng, 40) for _ in range(20)]  # boilerplate, of which each text has some
    texts = [" ".join(parts[k] for k in sorted(rng.sample(range(20), 17))) for _ in range(60)]
    texts = list(dict.fromkeys(texts))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert 10 < len(texts) - len(set(root))
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(8)
    found = {r.node: r.root for r in components.components(simhash.similar_pairs(df, crowd=crowd)).collect()}
    assert [found.get(k, k) for k in range(len(texts))] == root


def test_text_nodes_and_variants_without_close_pairs(spark):
    """Texts that share a variant but are not alike: batches of cells without any pair, with text nodes."""
    rng = random.Random(13)
    shared = words(rng, 300)
    texts = [shared + " " + words(rng, 190) for _ in range(60)] + [words(rng, 100) for _ in range(20)]
    sketches = np.stack([simhash._minima(simhash.shingle_hashes(t, 5)) for t in texts]).astype("<u2")
    keys = simhash._wild_keys(sketches, 0)
    assert max(np.unique(keys, return_counts=True)[1]) > 2  # a crowded variant
    df = spark.createDataFrame([(f"n{i}", t) for i, t in enumerate(texts)], "node string, text string").repartition(8)
    assert simhash.similar_pairs(df).collect() == [] and simhash.similar_pairs(df, crowd=2).collect() == []
    twice = df.union(df)  # repeated rows are one node
    near = twice.union(spark.createDataFrame([("x", texts[0] + " end")], df.schema))
    assert [tuple(r) for r in simhash.similar_pairs(near).collect()] == [("x", "n0")]


def test_wild_keys_meet_where_one_digit_differs():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (1, simhash.HASHES)).astype("<u2")
    for level, segments in enumerate(simhash.LEVELS):
        b = a.copy()
        b[0, segments[0][2]] ^= 1
        near, far = set(simhash._wild_keys(a, level)[0]), set(simhash._wild_keys(b, level)[0])
        hit = sum(segments[0][2] in s for s in segments)
        assert len(near & far) == hit + segments.shape[1] * (len(segments) - hit)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(5, 5), (5, 6), (300, 301)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    want = {i: 0 for i in range(61)} | {i: 200 for i in range(200, 260)} | {300: 300, 301: 300}
    assert got == want
    assert components.components(df.limit(0)).collect() == []
