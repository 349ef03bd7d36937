"""Alignment of two tokenizers over whole texts, by windows between whitespace-marked tokens.

Every text is tokenised whole by both. Where a token of each that starts with a blank begins at the same byte, both have a token
end before it: such verified ends cut a document into windows (a word or a few). A window is a pair of id tuples; its alignment
depends on nothing else, so it is remembered by them and only windows not yet met are aligned.

Corpus-wide counts of linked id pairs are documents per pair. Documents keep their distinct pairs as sorted arrays; the most
frequent pairs (at most ``hot_pairs``, a fixed number) are looked up in each task, all others by a join. A pair left to the join
holds less than about ``2 / hot_pairs`` of the links, so the join has no hot key.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tokencount import batches, byte_symbols
from ledgerlens.session import materialize


class BytePieces:
    """A byte-level BPE vocabulary file: ids of a text without special tokens, and each id's bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        # the byte-level word pattern (fixed value)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("alignment", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes[i] = piece

    def ids(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(" " + text)


class WordPieces:
    """A sentencepiece model that puts a blank before the text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.model.vocab_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)


def window_starts(a_starts: np.ndarray, a_marked: np.ndarray, b_starts: np.ndarray, b_marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, in both token lists, of the marked tokens that begin at one byte in both."""
    shared = np.intersect1d(a_starts[a_marked], b_starts[b_marked], assume_unique=True)
    return np.searchsorted(a_starts, shared), np.searchsorted(b_starts, shared)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For tokens given by their ascending byte ends: the first and last B token that each A token overlaps, and the numbers of
    A and of B tokens up to each shared end."""
    a_starts = np.concatenate([[0], a_ends[:-1]])
    first, last = np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_ends, a_ends, "left")
    shared = np.flatnonzero(b_ends[last] == a_ends)
    return first, last, shared + 1, last[shared] + 1


def distinct_windows(*sides: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One place of every distinct window, and for each window the place's number; a side is ids, starts and sizes.

    Windows meet by hash and are then compared token by token; one that differs from its hash's first stands for itself.
    """
    total = np.zeros(len(sides[0][1]), np.uint64)
    for seed, (ids, at, n) in enumerate(sides):
        weight = np.cumprod(np.full(int(n.max(initial=1)), 0x9E3779B97F4A7C15 + 2 * seed, np.uint64))
        inside = np.arange(len(ids)) - np.repeat(at, n)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * weight[inside]
        total = total * np.uint64(0x94D049BB133111EB) + np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), at)
    _, first, which = np.unique(total, return_index=True, return_inverse=True)
    like = first[which]
    same = np.ones(len(like), bool)
    for ids, at, n in sides:
        same &= n == n[like]
        other = np.minimum(np.repeat(at[like] - at, n) + np.arange(len(ids)), len(ids) - 1)
        same &= np.logical_and.reduceat(ids == ids[other], at)
    odd = np.flatnonzero(~same)
    which[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), which


class Windows:
    """Alignments of windows met so far: their groups as text, their number, and their linked pairs one after the other."""

    def __init__(self, a: BytePieces, b: WordPieces, remember: int = 1 << 27, longest: int = 64):
        self.a, self.b, self.remember, self.longest = a, b, remember, longest
        self.a_size, self.b_size = (np.array([len(x) for x in v.bytes], np.int64) for v in (a, b))
        self.a_marked, self.b_marked = (np.array([x.startswith(b" ") for x in v.bytes]) for v in (a, b))
        self.forget()

    def forget(self) -> None:
        self.place: dict[tuple[bytes, bytes], int] = {}
        self.text: list[str] = []
        self.groups, self.at, self.pairs, self.used = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), 0

    def _learn(self, a: np.ndarray, b: np.ndarray, spans: list[tuple[int, int, int, int]]) -> None:
        """Align the windows ``a[i:j], b[k:l]``, all in one pass over their tokens laid end to end."""
        a_n, b_n = (np.array([s[x + 1] - s[x] for s in spans], np.int64) for x in (0, 2))
        mine = np.concatenate([a[i:j] for i, j, _, _ in spans]), np.concatenate([b[k:m] for _, _, k, m in spans])
        first, last, a_cut, b_cut = overlaps(np.cumsum(self.a_size[mine[0]]), np.cumsum(self.b_size[mine[1]]))
        n = last - first + 1
        other = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs = np.repeat(mine[0], n) * len(self.b.bytes) + mine[1][other]
        own = np.searchsorted(a_cut, np.cumsum(a_n), "right")  # groups up to each window's end
        names, others = list(map(str, mine[0].tolist())), list(map(str, mine[1].tolist()))
        i = k = 0
        groups = []
        for j, m in zip(a_cut.tolist(), b_cut.tolist()):
            groups.append((names[i] if j - i == 1 else ",".join(names[i:j])) + "|" + (others[k] if m - k == 1 else ",".join(others[k:m])))
            i, k = j, m
        i = 0
        for j in own.tolist():
            self.text.append(";".join(groups[i:j]))
            i = j
        self.groups = np.concatenate([self.groups, np.diff(own, prepend=0)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)[np.cumsum(a_n) - 1]])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.used += 300 * len(spans) + 40 * len(pairs)

    def of(self, a: np.ndarray, b: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The remembered windows of texts laid end to end, in order, and each one's text.

        ``docs`` are the A tokens before each text that has tokens, and the end.
        """
        if self.used > self.remember:
            self.forget()
        a_starts, b_starts = (np.cumsum(size[ids]) - size[ids] for size, ids in ((self.a_size, a), (self.b_size, b)))
        a_at, b_at = window_starts(a_starts, self.a_marked[a], b_starts, self.b_marked[b])
        a_n, b_n = np.diff(a_at, append=len(a)), np.diff(b_at, append=len(b))
        some, which = distinct_windows((a, a_at, a_n), (b, b_at, b_n))
        names, others = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
        out, new, fresh = [], [], len(self.text)
        for i, n, k, m in zip(a_at[some].tolist(), a_n[some].tolist(), b_at[some].tolist(), b_n[some].tolist()):
            key = names[4 * i : 4 * (i + n)], others[4 * k : 4 * (k + m)]
            w = self.place.get(key)
            if w is None:
                w = fresh + len(new)
                new.append((i, i + n, k, k + m))
                if n + m <= self.longest:
                    self.place[key] = w
            out.append(w)
        if new:
            self._learn(a, b, new)
        return np.array(out, np.int64)[which], np.searchsorted(docs, a_at, "right") - 1

    def align(self, texts: list[str | None]) -> dict[str, pa.Array]:
        """One value for each text of: numbers of tokens, groups and links, the groups' hash, distinct pairs and their times."""
        found, kept = [], []
        for i, text in enumerate(texts):
            whole = (" " + (text or "")).encode()
            a, b = (self.a.ids(text), self.b.ids(text)) if text else ([], [])
            if a and b"".join(map(self.a.bytes.__getitem__, a)) == whole and b"".join(map(self.b.bytes.__getitem__, b)) == whole:
                found.append((a, b))
                kept.append(i)
        n = np.zeros((4, len(texts)), np.int64)
        digest, ends = [""] * len(texts), np.zeros(len(texts), np.int64)
        keys = times = np.zeros(0, np.int64)
        if kept:
            n[0, kept], n[1, kept] = [len(a) for a, _ in found], [len(b) for _, b in found]
            a, b = (np.concatenate([np.array(x[side], np.int64) for x in found]) for side in (0, 1))
            windows, owner = self.of(a, b, np.concatenate([[0], np.cumsum(n[0, kept])]))
            n[2, kept] = np.bincount(owner, weights=self.groups[windows], minlength=len(kept)).astype(np.int64)
            cuts = np.searchsorted(owner, np.arange(len(kept) + 1))
            for i, x, y in zip(kept, cuts.tolist(), cuts[1:].tolist()):
                digest[i] = hashlib.sha256(";".join([self.text[w] for w in windows[x:y].tolist()]).encode()).hexdigest()
            size = self.at[windows + 1] - self.at[windows]
            n[3, kept] = np.bincount(owner, weights=size, minlength=len(kept)).astype(np.int64)
            pairs = self.pairs[np.repeat(self.at[windows] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            span = len(self.a.bytes) * len(self.b.bytes)
            keys, times = np.unique(np.repeat(owner, size) * span + pairs, return_counts=True)
            ends[kept] = np.bincount(keys // span, minlength=len(kept))
            keys %= span
        lists = lambda values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ends)]), pa.int32()), values)
        numbers = {name: pa.array(n[i]) for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
        return {**numbers, "groups_sha256": pa.array(digest), "pairs": lists(pa.array(keys.astype(np.int64))), "times": lists(pa.array(times.astype(np.int32)))}


@lru_cache(1)
def _windows(path_a: str, path_b: str) -> Windows:
    return Windows(BytePieces(path_a), WordPieces(path_b))


NUMBERS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the numbers of ``NUMBERS``, and the distinct linked pairs with their times, of every row; a map."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(path_a, path_b)
        for x in parts:
            at = 0
            for texts in batches([t or "" for t in x.column("text").to_pylist()], 1 << 20):
                columns = {"doc_id": x.column("doc_id").slice(at, len(texts)), **windows.align(texts)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                at += len(texts)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, {NUMBERS}, pairs array<long>, times array<int>")


def _scored(rows: DataFrame, keys: np.ndarray, counts: np.ndarray, best: np.ndarray) -> DataFrame:
    """Sums over each row's pairs that are in ``keys``, and its other pairs."""
    shared = rows.sparkSession.sparkContext.broadcast((keys, counts, best))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for x in parts:
            pairs, times = (x.column(n).flatten().to_numpy() for n in ("pairs", "times"))
            ends = np.concatenate([[0], np.cumsum(x.column("pairs").value_lengths().to_numpy())])
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            at, weight = np.where(known, at, 0), times * known
            total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[ends])
            sums = [total(weight * v[at]) if len(keys) else np.zeros(x.num_rows, np.int64) for v in (best, counts)]
            rest = pa.array(np.concatenate([[0], np.cumsum(~known)])[ends], pa.int32())
            more = [pa.ListArray.from_arrays(rest, pa.array(v[~known])) for v in (pairs, times)]
            names = [n for n in x.schema.names if n not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*(x.column(n) for n in names), *map(pa.array, sums), *more], names=[*names, "n_best", "count_sum", "pairs", "times"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {NUMBERS}, row long, n_best long, count_sum long, pairs array<long>, times array<int>")


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """``pair, a, b, docs, best``: the documents that hold each id pair linked, and whether none of its A id's pairs has more."""
    counted = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    counted = materialize(counted.withColumn("a", F.floor(F.col("pair") / b_size).cast("int")), "pairs")
    most = F.broadcast(counted.groupBy("a").agg(F.max("docs").alias("most")))  # at most a row for each id of the vocabulary
    return counted.join(most, "a").select("pair", "a", (F.col("pair") % b_size).cast("int").alias("b"), "docs", (F.col("docs") == F.col("most")).cast("long").alias("best"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", hot_pairs: int = 1 << 18) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``path_a`` is a byte-level BPE file, ``path_b`` a sentencepiece model; both read the text after one blank. Texts that are null or
    empty, or whose tokens don't spell that text (normalised by B, or holding U+2581), have no tokens: zeros and an empty hash. Repeated rows count as documents of their own and
    come out once each, null ids too; other columns are not read. ``hot_pairs`` bounds what is broadcast, not what is counted.
    """
    rows = materialize(aligned(docs, path_a, path_b, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(pair_counts(rows, len(WordPieces(path_b).bytes)), "counts")
    bins = counts.groupBy(F.floor(F.log2("docs")).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()  # at most 64 rows
    least, room = 64, hot_pairs
    for bin_, n in sorted(((r["bin"], r["n"]) for r in bins), reverse=True):
        if n > room:
            break
        least, room = bin_, room - n
    hot = counts.where(F.col("docs") >= F.lit(2.0**least)).select("pair", "docs", "best").orderBy("pair").toPandas()
    scored = materialize(_scored(rows, *(hot[c].to_numpy(np.int64) for c in ("pair", "docs", "best"))), "scored")
    cold = scored.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    met = cold.join(counts.where(F.col("docs") < F.lit(2.0**least)).hint("merge"), "pair")
    more = met.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more_sum"))
    out = scored.drop("pairs", "times").join(more.hint("merge"), "row", "left")
    total = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("n_best", "more_best"), total("count_sum", "more_sum"), "groups_sha256")
