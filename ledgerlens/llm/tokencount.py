"""Token counts by rank-synchronous merging of ragged symbol arrays, for a byte-level BPE with word-end symbols."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.arrow import add_columns

NO_RANK = np.iinfo(np.int64).max
# Unicode's White_Space characters (fixed values)
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def merged_counts(symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray, width: int) -> np.ndarray:
    """Symbols that survive in each sequence once no pair of neighbours has a rank.

    ``symbols`` holds all sequences one after the other, ``sizes`` their lengths (at least 1). ``keys`` are the sorted pairs
    ``left * width + right`` with their ``ranks`` and the symbols ``made``. In each step every sequence merges all places of
    its own lowest-ranked pair, from the left where they overlap; finished sequences leave the arrays.
    """
    counts = sizes.astype(np.int64).copy()
    names = np.arange(len(sizes))
    while len(symbols):
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        pair = symbols[:-1].astype(np.int64) * width + symbols[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        known = (keys[at] == pair) & (owner[:-1] == owner[1:])
        rank = np.full(len(symbols), NO_RANK)
        rank[:-1][known] = ranks[at[known]]
        low = np.minimum.reduceat(rank, starts)
        live = low != NO_RANK
        counts[names[~live]] = sizes[~live]
        hit = (rank == low[owner]) & (rank != NO_RANK)
        place = np.flatnonzero(hit)
        # of overlapping places (a run of x x x) every second one merges
        first = np.ones(len(place), bool)
        first[1:] = np.diff(place) != 1
        run = np.maximum.accumulate(np.where(first, np.arange(len(place)), 0)) if len(place) else place
        place = place[(np.arange(len(place)) - run) % 2 == 0]
        symbols = symbols.copy()
        symbols[place] = made[at[place]]
        keep = live[owner]
        keep[place + 1] = False
        sizes = np.bincount(owner[keep], minlength=len(sizes))[live]
        symbols, names = symbols[keep], names[live]
    return counts


class WordBpe:
    """Counts tokens as the vocabulary file's own library does: added tokens, NFC, lower case, word pattern, byte BPE."""

    def __init__(self, path: str, remember: int = 300_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges, end = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"] or ""
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        _, first = np.unique(key, return_index=True)
        self.keys, self.ranks = key[first], first.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[first]
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        # the file's word pattern, with its white space spelled out
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.remember, self.young, self.old = remember, {}, {}

    def _words(self, chunk: str) -> tuple[list[str], int]:
        """The words of a text without added tokens, and the number of added tokens."""
        parts = self.added.split(chunk)
        lower = [unicodedata.normalize("NFC", p).replace("Σ", "σ").lower() for p in parts]
        return [w for p in lower for w in self.words.findall(p)], len(parts) - 1

    def _count_chunks(self, chunks: list[bytes]) -> list[int]:
        words, owner, added = {}, [], []
        uses = []
        for i, chunk in enumerate(chunks):
            own, extra = self._words(chunk.decode())
            added.append(extra)
            uses += [words.setdefault(w, len(words)) for w in own]
            owner += [i] * len(own)
        if not words:
            return added
        data = [w.encode() for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        counts = merged_counts(symbols, sizes, self.keys, self.ranks, self.made, self.width)
        total = np.bincount(owner, weights=counts[uses], minlength=len(chunks)).astype(np.int64) + added
        return total.tolist()

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Texts are cut at blanks, where no word, added token or composed letter goes on; the counts
        of pieces are remembered in two generations of bounded size."""
        split = [t.encode().split() for t in texts]  # bytes are cut at the six ASCII blanks only
        missing = []
        for chunks in split:
            for c in set(chunks):
                if c not in self.young:
                    got = self.old.get(c)
                    if got is None:
                        missing.append(c)
                    self.young[c] = got
        for at in range(0, len(missing), 1 << 15):
            part = missing[at : at + (1 << 15)]
            self.young.update(zip(part, self._count_chunks(part)))
        find = self.young.__getitem__
        out = [sum(map(find, chunks)) for chunks in split]
        if len(self.young) > self.remember:
            self.old, self.young = self.young, {}
        return out


@lru_cache(2)
def _counter(path: str) -> WordBpe:
    return WordBpe(path)


def batches(texts: list[str], chars: int = 1 << 22) -> Iterator[list[str]]:
    """Consecutive texts of about ``chars`` characters; a longer text is a batch of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def token_counts(docs: DataFrame, path: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row: a map without a shuffle.

    ``path`` names the vocabulary file, present on every machine. A null text counts as an empty one (no tokens); repeated
    rows come out once each and columns other than the two named are not read.
    """

    def of(texts: list[str | None]) -> list:
        counter, texts = _counter(path), [t or "" for t in texts]
        return [[n for part in batches(texts) for n in counter.counts(part)]]

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counted = add_columns(source, "text", of, [("n_tokens", "long")])
    counted = counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
