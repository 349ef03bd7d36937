"""Token alignment against a plain version with byte sets; edge rows; the join of rare pairs."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import alignment

from .common import edge_docs, edge_rows, no_docs, words

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a<|endoftext|>b </s> <unk>", "tabs\tand\n\nlines \r\n  x   ", "▁under", "中文没有空格 的 文本", "été 🙂🙂 ﬁ", "x" * 3000, " ", "\n", "a  b   c    d", "don't we'll 12345 !!??", "\x00 nul", "ｆｕｌｌ ｗｉｄｔｈ",
    " lead", "trail ", "https://a.b/c?d=e&f=g <p class='x'>", "नमस्ते दुनिया", " nb sp",
]


def expected(rows):
    """Everything with the libraries themselves and one loop over bytes."""
    fast = Tokenizer.from_file(A)
    fast.encode_special_tokens = True
    names = {i: t for t, i in fast.get_vocab().items()}
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}
    piece = sentencepiece.SentencePieceProcessor(model_file=B)
    told = []
    for ident, text in rows:
        whole = (" " + (text or "")).encode()
        a = fast.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = piece.encode(text) if text else []
        a_bytes = [bytes(byte_of[c] for c in names[i]) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in map(piece.id_to_piece, b)]
        if not a or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            told.append((ident, [], [], [], 0))
            continue
        ends_a = [sum(map(len, a_bytes[: i + 1])) for i in range(len(a))] if len(a) < 400 else None
        if ends_a is None:
            ends_a, total = [], 0
            for x in a_bytes:
                total += len(x)
                ends_a.append(total)
        ends_b, total = [], 0
        for x in b_bytes:
            total += len(x)
            ends_b.append(total)
        owner_a = [i for i, x in enumerate(a_bytes) for _ in x]
        owner_b = [i for i, x in enumerate(b_bytes) for _ in x]
        links = sorted({(i, k) for i, k in zip(owner_a, owner_b)})
        groups, i, k = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            j, m = ends_a.index(end) + 1 if len(a) < 400 else next(x for x in range(i, len(a)) if ends_a[x] == end) + 1, next(x for x in range(k, len(b)) if ends_b[x] == end) + 1
            groups.append(",".join(map(str, a[i:j])) + "|" + ",".join(map(str, b[k:m])))
            i, k = j, m
        told.append((ident, a, b, groups, [(a[i], b[k]) for i, k in links]))
    docs = Counter(p for *_, links in told if links for p in set(links))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for ident, a, b, groups, links in told:
        links = links or []
        best = sum(docs[p] == most[p[0]] for p in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((ident, len(a), len(b), len(groups), len(links), best, sum(docs[p] for p in links), digest))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot_pairs", [1 << 18, 40, 0])
def test_equals_plain_version(spark, hot_pairs):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, words(rng, rng.randint(1, 60))) for i in range(60)] + [(7, ODD[1]), (None, "one two"), (900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = alignment.align_tokens(df, A, B, hot_pairs=hot_pairs)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_edge_rows_and_empty_table(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    got = alignment.align_tokens(edge_docs(spark), A, B)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)
    assert alignment.align_tokens(no_docs(spark), A, B).count() == 0


def test_clashing_columns_are_not_read(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ["pairs", "times", "row", "pair", "n_a", "best"]})
    assert alignment.align_tokens(df, A, B).first()["n_a"] == 2


def test_memory_of_windows_is_given_up():
    windows = alignment.Windows(alignment.BytePieces(A), alignment.WordPieces(B), remember=2000)
    fresh = alignment.Windows(alignment.BytePieces(A), alignment.WordPieces(B))
    rng = random.Random(6)
    for _ in range(20):
        texts = [words(rng, 30) for _ in range(3)] + ODD
        assert windows.align(texts) == fresh.align(texts)
    assert len(windows.place) < len(fresh.place)
