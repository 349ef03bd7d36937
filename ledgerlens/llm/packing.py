"""Packing of tokenised documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import json
import re
import sys
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.arrow import explode_text
from ledgerlens.llm.tokencount import batches, byte_symbols
from ledgerlens.session import materialize

SPACES = pa.array(["", *(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())], pa.string())
INNER_BLANK = re.compile(r" (?=\s|\Z)(?<=\s )")


class ByteBpe:
    """Ids of whole texts, as the vocabulary file's own library gives them; ``remember`` short beginnings of texts are kept."""

    def __init__(self, path: str, remember: int = 200_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {w: i for w, i in spec["model"]["vocab"].items() if w not in added}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in vocab.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [vocab[a + b] for a, b in pairs]
        if order != sorted(order):
            raise ValueError("ids don't follow the order of the merges")
        # the byte-level word pattern (fixed value)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, i in ranks.items():
            self.bytes_of[i] = len(word)
        self.added = {w: np.array([i], "<u4").tobytes() for w, i in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self._short = lru_cache(remember)(self._fresh)

    def _fresh(self, piece: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(piece), "<u4").tobytes()

    def _parts(self, texts: list[str]) -> tuple[list[bytes], list[str], list[int]]:
        """The texts' parts (added tokens and what stands between them): each one's head as ids, the rest from its first blank
        on, and the number of parts up to each text's end. A blank starts a new word unless it stands inside a run of white
        space: a part with such a blank is all head, elsewhere the head ends before the first blank."""
        heads, rests, last = [], [], []
        for t in texts:
            for k, p in enumerate(self.split.split(t) if self.split and any(w in t for w in self.added) else [t]):
                head = p if k % 2 or INNER_BLANK.search(p) else p.split(" ", 1)[0]
                heads.append(self.added[p] if k % 2 else self._short(head) if len(head) <= 32 else self._fresh(head))
                rests.append(p[len(head) :])
            last.append(len(rests))
        return heads, rests, last

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of blank-led words, one after the other, and the number for each, from one call of the library: before a
        word a blank always starts a new token, so the joined ids fall apart at the words' last bytes."""
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py()
        ids = np.array(self.encoding.encode_ordinary(" " + joined), "<u4")
        stops = 1 + np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(1 + pc.binary_length(words).to_numpy()))
        return ids, np.diff(stops, prepend=0)

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and where each ends; added tokens inside a text have their own id.

        Arrow cuts and numbers the blank-led pieces, so each different one is encoded once, however often it stands there.
        """
        heads, rests, last = self._parts(texts)
        cut = pc.split_pattern(pa.array(rests, pa.string()), " ")
        numbered = cut.flatten().dictionary_encode()
        pieces, starts = numbered.dictionary, cut.offsets.to_numpy()
        # empty pieces and those that begin with white space are encoded alone
        alone = pc.is_in(pc.utf8_slice_codeunits(pieces, 0, 1), value_set=SPACES)
        others = heads + [self._fresh(" " + p) for p in pieces.filter(alone).to_pylist()]
        ids, sizes = self._words(pc.if_else(alone, "x", pieces))
        ids = np.concatenate([ids, np.frombuffer(b"".join(others), "<u4")])
        sizes = np.concatenate([sizes, np.fromiter(map(len, others), np.int64, len(others)) // 4])
        number = np.arange(len(pieces))
        number[alone.to_numpy(zero_copy_only=False)] = np.arange(len(pieces) + len(heads), len(sizes))
        item = number[numbered.indices.to_numpy()]
        item[starts[:-1]] = len(pieces) + np.arange(len(heads))  # nothing stands before a rest's first blank: the head's place
        # the stretch of ids of every item
        n = sizes[item]
        ends = np.cumsum(n)
        shift = (np.cumsum(sizes) - sizes)[item] - (ends - n)
        return ids[np.repeat(shift, n) + np.arange(n.sum())], ends[starts[last] - 1]

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of one text."""
        return self.many([text])[0].tobytes()


@lru_cache(2)
def _encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``uid, doc_id, piece, start, length, ids_crc32`` of every document, cut only where it is longer than ``capacity``.

    A document is its ids and then ``end_id``; a null text is an empty one. Cuts leave whole pieces of ``capacity`` at the
    end and the rest in the first piece. ``uid`` names the piece; rows with one doc_id stay apart.
    """

    def of(texts: list[str | None]) -> tuple:
        encoder, end, rows, i = _encoder(path), np.array([end_id], "<u4").tobytes(), [], 0
        for part in batches([t or "" for t in texts]):
            flat, ends = encoder.many(part)
            raw, before = memoryview(flat.tobytes()), 0
            for stop in ends.tolist():
                ids = bytes(raw[4 * before : 4 * stop]) + end
                n = stop - before + 1
                first = n if n <= capacity else n % capacity or capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    length = first if k == 0 else capacity
                    rows.append((i, k, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])))
                before, i = stop, i + 1
        at, *found = zip(*rows) if rows else ([],) * 5
        return at, found

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    cut = explode_text(source, "text", of, [("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")])
    return materialize(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")


class Packing:
    """Bins of items, with the bins of each free capacity at hand so that best fit is one bit search."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: dict[int, list[int]] = {}
        self.free: dict[int, int] = {}
        self.by_free: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.mask, self.next = 0, 0

    def _file(self, b: int, free: int) -> None:
        self.free[b] = free
        self.by_free[free].add(b)
        self.mask |= 1 << free

    def _unfile(self, b: int) -> None:
        free = self.free.pop(b)
        self.by_free[free].discard(b)
        if not self.by_free[free]:
            self.mask &= ~(1 << free)

    def add_bin(self, items: list[int]) -> None:
        self.bins[self.next] = list(items)
        self._file(self.next, self.capacity - sum(self.sizes[i] for i in items))
        self.next += 1

    def drop_bin(self, b: int) -> list[int]:
        self._unfile(b)
        return self.bins.pop(b)

    def best_fit(self, items: list[int]) -> None:
        """Place items, largest first, each where it leaves the least room."""
        for i in sorted(items, key=lambda i: -self.sizes[i]):
            fitting = self.mask >> self.sizes[i]
            if not fitting:
                self.add_bin([i])
                continue
            free = (fitting & -fitting).bit_length() - 1 + self.sizes[i]
            b = min(self.by_free[free])
            self._unfile(b)
            self.bins[b].append(i)
            self._file(b, free - self.sizes[i])

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones: the mean squared filling."""
        return -len(self.bins), sum((1 - f / self.capacity) ** 2 for f in self.free.values()) / max(1, len(self.bins))


def crossover(a: Packing, b: Packing, rng: np.random.Generator) -> Packing:
    """A copy of ``a`` with well-filled bins of ``b`` injected; bins of ``a`` that share an item go, their others are best-fitted."""
    full = sorted(b.bins, key=lambda k: (b.free[k], k))
    chosen = [k for k in full[: max(1, len(full) // 2)] if rng.random() < 0.5] or full[:1]
    taken = {i for k in chosen for i in b.bins[k]}
    child, displaced = Packing(a.sizes, a.capacity), []
    for items in a.bins.values():
        if taken.isdisjoint(items):
            child.add_bin(items)
        else:
            displaced += [i for i in items if i not in taken]
    for k in chosen:
        child.add_bin(b.bins[k])
    # the emptiest bins are dissolved as well, so that their items can settle elsewhere
    for k in sorted(child.bins, key=lambda k: (-child.free[k], k))[: 1 + len(child.bins) // 50]:
        displaced += child.drop_bin(k)
    child.best_fit(displaced)
    return child


def evolve(sizes: list[int], capacity: int, given: list[list[int]], seed: int, population: int = 4, generations: int = 6) -> Packing:
    """Improve a population that starts with the ``given`` bin numbers and best-fit packings; returns the elite.

    Stops early at the lower bound, which no packing can beat.
    """
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // capacity)
    people = []
    for bins in given:
        p, groups = Packing(sizes, capacity), {}
        for i, b in enumerate(bins):
            groups.setdefault(b, []).append(i)
        for b in sorted(groups):
            p.add_bin(groups[b])
        people.append(p)
    while len(people) < population and (not people or -max(p.fitness() for p in people)[0] > least):
        p, items = Packing(sizes, capacity), list(range(len(sizes)))
        if people:  # others start from a few random bins
            shuffled = rng.permutation(len(sizes)).tolist()[: len(sizes) // 4]
            p.best_fit(shuffled)
            placed = set(shuffled)
            items = [i for i in items if i not in placed]
        p.best_fit(items)
        people.append(p)
    for _ in range(generations):
        people.sort(key=Packing.fitness, reverse=True)
        if len(people[0].bins) <= least or len(people) < 2:
            break
        mother, father = people[0], people[1 + int(rng.integers(len(people) - 1))]
        for child in (crossover(mother, father, rng), crossover(father, mother, rng)):
            if child.fitness() > people[-1].fitness():
                people[-1] = child
                people.sort(key=Packing.fitness, reverse=True)
    return max(people, key=Packing.fitness)


def _numbers(p: Packing) -> list[int]:
    out = [0] * len(p.sizes)
    for b, items in enumerate(p.bins.values()):
        for i in items:
            out[i] = b
    return out


def _island(capacity: int, last: bool):
    """One island's turn, or with ``last`` the meeting of all elites of a shard that settles its placement."""

    def of(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["origin", "length", "uid"], ascending=[True, False, True], kind="stable")
        uid = x.loc[x["origin"] == x["origin"].iloc[0], ["uid", "length"]]
        order = uid["uid"].to_numpy()
        sizes = uid["length"].tolist()
        given = []
        for origin, own in x.groupby("origin"):
            if origin >= 0:
                given.append(own.set_index("uid")["bin"].loc[order].tolist())
        shard, island = int(x["shard"].iloc[0]), int(x["island"].iloc[0])
        best = evolve(sizes, capacity, given, seed=1_000_003 * shard + island, generations=6)
        out = pd.DataFrame({"shard": shard, "uid": order, "length": sizes, "bin": _numbers(best)})
        if not last:
            return out.assign(island=island, origin=island)
        out = out.sort_values(["bin", "length", "uid"], ascending=[True, False, True], kind="stable")
        end = out.groupby("bin")["length"].cumsum()
        return out.assign(offset=end - out["length"], fill=out.groupby("bin")["length"].transform("sum"))

    return of


def place(items: DataFrame, capacity: int = 2048, shard_items: int = 2048, islands: int = 2, settled: float = 0.98, passes: int = 4) -> DataFrame:
    """``uid, sequence_id, offset`` for items ``uid, length`` (unique uid, length 1 to ``capacity``) in few sequences.

    Items are dealt at random into shards of about ``shard_items``, a fixed size whatever the input, so all shards have the
    same mixture of lengths. Each shard's islands evolve their own populations, elites migrate to the next island, and the
    elites meet. Bins filled to ``settled`` are final; the items of the others go into the next pass's fewer shards, so the
    waste doesn't grow with the number of shards. After ``passes`` passes, or once nothing is gained, all bins are final.
    """
    rows, done = items.select("uid", F.col("length").cast("long").alias("length")), []
    count = rows.count()
    for turn in range(passes):
        shards = max(1, -(-count // shard_items))
        dealt = rows.select("uid", "length", F.pmod(F.xxhash64(F.lit(turn), "uid"), F.lit(shards)).alias("shard"))
        start = dealt.select("*", F.explode(F.array(*[F.lit(i).cast("long") for i in range(islands)])).alias("island"))
        start = start.withColumns({"bin": F.lit(0).cast("long"), "origin": F.lit(-1).cast("long")})
        kind = "shard long, uid long, length long, bin long, island long, origin long"
        first = start.groupBy("shard", "island").applyInPandas(_island(capacity, False), kind)
        hosts = F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands))) if islands > 1 else F.array("island")
        moved = first.select("shard", "uid", "length", "bin", "origin", F.explode(F.array_distinct(hosts)).alias("island"))
        second = moved.groupBy("shard", "island").applyInPandas(_island(capacity, False), kind)
        met = second.groupBy("shard").applyInPandas(_island(capacity, True), "shard long, uid long, length long, bin long, offset long, fill long")
        result = materialize(met.withColumn("sequence_id", F.lit(turn << 60) + F.col("shard") * (1 << 20) + F.col("bin")), "bins")
        final = F.col("fill") >= int(settled * capacity)
        open_items = result.where(~final).count()
        over = turn == passes - 1 or shards == 1 or open_items == 0
        done.append((result if over else result.where(final)).select("uid", "sequence_id", "offset"))
        if over:
            break
        rows, count = result.where(~final).select("uid", "length"), open_items
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack every document; returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece.

    Every token of every text comes out once. Within a sequence the pieces lie without gaps from offset 0. An empty table
    gives an empty one; other columns are not read.
    """
    pieces = token_pieces(docs, path, capacity, end_id, doc_id, text)
    placed = place(pieces, capacity)
    return pieces.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
