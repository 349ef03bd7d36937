import hashlib
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import linededup, packing, tokencount
from tests.llm.common import edge_docs, edge_rows, no_docs

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXT = st.text(alphabet="abcABCΣσİéÉ́ \n\t\x1c\x85\xa0 '1²٣!?<|>_-.,日語한\U0001f642", max_size=60)


def slow_lines(rows, min_chars=20, min_docs=3):
    blank = " \t\n\x0b\x0c\r"
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(blank))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = []
        for s in lines:
            ids = held.get(key(s), ())
            biggest = max((x for x in ids if x is not None), default=None)
            if len(ids) < min_docs or i == biggest:
                keep.append(s)
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out


def test_line_dedup(spark):
    rows = [r[:2] for r in edge_rows()]
    rows += [(100 + i, f"own line number {i} of this text\nThe very same line in all of them\n\nThe very same line in all of them") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in linededup.drop_shared_lines(df).collect()]
    assert sorted(got, key=repr) == sorted(slow_lines(rows), key=repr)


def test_line_dedup_edges(spark):
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in linededup.drop_shared_lines(edge_docs(spark)).collect()]
    assert sorted(got, key=repr) == sorted(slow_lines([r[:2] for r in edge_rows()]), key=repr)
    assert linededup.drop_shared_lines(no_docs(spark)).collect() == []


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_counts_equal_the_library(text):
    assert COUNTER.counts([text]) == [len(LIBRARY.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_byte_ids_equal_the_library(text):
    assert np.frombuffer(ENCODER.ids(text), "<u4").tolist() == BYTE_LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(TEXT, st.sampled_from(["<|endoftext|>", "  ", " \n", "the word "])), max_size=4).map("".join), min_size=1, max_size=8))
def test_byte_ids_of_many_texts(texts):
    flat, ends = ENCODER.many(texts)
    got = [x.tolist() for x in np.split(flat, ends)]
    assert got == [*[BYTE_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts], []]


def test_different_pieces_are_encoded_together_and_once():
    encoder, calls = packing.ByteBpe(BYTES), []
    encode = encoder.encoding.encode_ordinary
    encoder.encoding = SimpleNamespace(encode_ordinary=lambda piece: calls.append(piece) or encode(piece))
    texts = ["All of " + " ".join(f"unwonted{i * j % 997}\nword" for j in range(200)) + " end" for i in range(300)]
    got = [x.tolist() for x in np.split(*encoder.many(texts))]
    assert got == [*[BYTE_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts], []]
    # one call a piece took most of the time
    assert len(calls) <= 5 and sum(map(len, calls)) < sum(map(len, texts)) / 20


COUNTER, LIBRARY = tokencount.WordBpe(WORDS, remember=50), Tokenizer.from_file(WORDS)
ENCODER, BYTE_LIBRARY = packing.ByteBpe(BYTES, remember=50), Tokenizer.from_file(BYTES)


@pytest.mark.parametrize("text", ["<|endoftext|> a <|startoftext|><|endoftext|>x", "a" * 3000, "it's we'LL  \n  x ", "x<|endoftext|>́"])
def test_special_texts(text):
    assert COUNTER.counts([text]) == [len(LIBRARY.encode(text, add_special_tokens=False).ids)]
    assert np.frombuffer(ENCODER.ids(text), "<u4").tolist() == BYTE_LIBRARY.encode(text, add_special_tokens=False).ids


def test_token_counts_edges(spark):
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(edge_docs(spark), WORDS, 2048).collect()), key=repr)
    want = []
    for i, t, *_ in edge_rows():
        n = len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want, key=repr)
    assert tokencount.token_counts(no_docs(spark), WORDS).collect() == []


def check_packing(rows, got, capacity):
    """Every piece of every document once, cut as promised, gapless in its sequence."""
    want = []
    for i, t in rows:
        ids = [*BYTE_LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for k, s in enumerate(starts):
            part = ids[s : starts[k + 1] if k + 1 < len(starts) else None]
            want.append((i, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(w[3] for w in want)


def test_packing(spark):
    rows = [r[:2] for r in edge_rows()]
    check_packing(rows, packing.pack(edge_docs(spark), BYTES).collect(), 2048)
    many = [(i, "word " * (i * 37 % 300)) for i in range(1500)]
    df = spark.createDataFrame(many, "doc_id long, text string")
    bins, tokens = check_packing(many, packing.pack(df, BYTES, 512).collect(), 512)
    assert bins <= 1.01 * tokens / 512 + 1
    assert packing.pack(no_docs(spark), BYTES).collect() == []


def test_placement_over_many_shards(spark):
    df = spark.range(3000).selectExpr("id AS uid", "1 + (id * 7919) % 1000 AS length")
    got = packing.place(df, 1000, shard_items=200).join(df, "uid").groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in got) <= 1000 and sum(r[1] for r in got) == df.groupBy().sum("length").first()[0]
    # evenly spread lengths waste about the root of a shard's size, the worst case for small shards
    assert len(got) <= 1.03 * sum(r[1] for r in got) / 1000


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 400, 200).tolist()
    a, b = packing.Packing(sizes, 500), packing.Packing(sizes, 500)
    a.best_fit(list(range(200)))
    for i in rng.permutation(200).tolist():
        b.best_fit([i])
    for _ in range(5):
        child = packing.crossover(a, b, rng)
        assert sorted(i for items in child.bins.values() for i in items) == list(range(200))
        assert all(sum(sizes[i] for i in items) <= 500 for items in child.bins.values())
    assert packing.evolve(sizes, 500, [], 1).fitness() >= a.fitness()
