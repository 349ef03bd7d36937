"""Periodic runs of words, by longest common extensions in suffix trees.

A run is a stretch with a smallest period that no neighbouring word extends. Every run of at least two periods holds a longest
Lyndon word of the period's length, in the usual or in the reversed order of words: each position gives one candidate root in each
order, and is extended to the right and to the left by longest common extensions. These are depths of lowest common ancestors in
the suffix tree (Ukkonen) of the words and of their reversal, answered from a range minimum over the Euler tour.

Trees are built only where a run can be. A run of at least ``periods`` periods and ``least`` words repeats its first words at the
distance of the period, so it lies inside a chain of stretches between equal neighbouring word groups; chains are found by hashes over
the whole text. A hash can add stretches, never hide one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.arrow import map_rows

Run = tuple[int, int, int]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def words_of(text: str | None) -> list[bytes]:
    """The words between ASCII white space."""
    return (text or "").encode().split()


# -- suffix tree ---------------------------------------------------------------------------------------------------------------
class SuffixTree:
    """Ukkonen's suffix tree of a list of small integers, closed by one that occurs nowhere else.

    Node 0 is the root. ``start`` and ``end`` delimit the label of the edge into a node; leaves end at the text's end.
    """

    def __init__(self, symbols: Sequence[int]):
        text = self.text = [*symbols, -1]
        n = self.n = len(text)
        start, end, link, kids = [0], [0], [0], [{}]
        node, edge, length, todo = 0, 0, 0, 0
        for i, symbol in enumerate(text):
            last, todo = 0, todo + 1
            while todo:
                if not length:
                    edge = i
                first = text[edge]
                child = kids[node].get(first)
                if child is None:
                    kids[node][first] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    kids.append(None)
                    if last:
                        link[last] = node
                    last = node
                else:
                    size = (end[child] if end[child] < i + 1 else i + 1) - start[child]
                    if length >= size:  # walk down
                        edge += size
                        length -= size
                        node = child
                        continue
                    if text[start[child] + length] == symbol:
                        if last and node:
                            link[last] = node
                        length += 1
                        break
                    split = len(start)
                    kids[node][first] = split
                    start.append(start[child])
                    end.append(start[child] + length)
                    link.append(0)
                    kids.append({symbol: split + 1, text[start[child] + length]: child})
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    kids.append(None)
                    start[child] += length
                    if last:
                        link[last] = split
                    last = split
                todo -= 1
                if not node and length:
                    length -= 1
                    edge = i - todo + 1
                elif node:
                    node = link[node]
        self.start, self.end, self.kids = start, end, kids

    def tour(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Euler tour with children in ascending (1) or descending (-1) order of their first words, the closing one first.

        Returns the depths along the tour, each suffix's place in it and each suffix's rank.
        """
        text, start, end, kids, n = self.text, self.start, self.end, self.kids, self.n
        rank = (lambda x: x) if order > 0 else (lambda x: -x if x >= 0 else -(n + 2))
        depths, place, ranks, found = [0], [0] * n, [0] * n, 0
        walk = lambda node: iter([c for _, c in sorted((rank(s), c) for s, c in kids[node].items())])
        stack = [(0, walk(0))]
        while stack:
            depth, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                stack.pop()
                if stack:
                    depths.append(stack[-1][0])
                continue
            below = depth + end[child] - start[child]
            if kids[child] is None:
                suffix = n - below
                place[suffix], ranks[suffix] = len(depths), found
                found += 1
                depths += (below, depth)
            else:
                depths.append(below)
                stack.append((below, walk(child)))
        return np.array(depths, np.int32), np.array(place, np.int64), np.array(ranks, np.int64)


def minima(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least of ``values[left..right]`` of each query, two look-ups each in a table of powers of two.

    All queries are known, so the table is gone through level by level and only one level is held.
    """
    level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    out, table, order = np.zeros(len(left), values.dtype), values, np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[order], np.arange(level.max(initial=0) + 2))
    for k in range(len(cuts) - 1):
        if k:
            table = np.minimum(table[: -(1 << k - 1)], table[1 << k - 1 :])
        q = order[cuts[k] : cuts[k + 1]]
        out[q] = np.minimum(table[left[q]], table[right[q] - (1 << k) + 1])
    return out


def common_extensions(depths: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How long the suffixes ``a`` and ``b`` (different ones) agree: the depth of their lowest common ancestor."""
    x, y = place[a], place[b]
    return minima(depths, np.minimum(x, y), np.maximum(x, y)).astype(np.int64)


def lyndon_lengths(ranks: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word at each position: the distance to the next smaller suffix."""
    n, rank = len(ranks), ranks.tolist()
    out, stack = [0] * n, []
    for i in range(n - 1, -1, -1):
        while stack and rank[stack[-1]] > rank[i]:
            stack.pop()
        out[i] = (stack[-1] if stack else n) - i
        stack.append(i)
    return np.array(out, np.int64)


def runs_in(symbols: Sequence[int], least: int, periods: int) -> list[Run]:
    """``(start, length, period)`` of each run with ``length >= max(least, periods * period)`` in a list of small integers."""
    n = len(symbols)
    if n < max(least, 2):
        return []
    tree = SuffixTree(symbols)
    depths, place, ranks = tree.tour(1)
    roots = [lyndon_lengths(ranks[:n]), lyndon_lengths(tree.tour(-1)[2][:n])]
    del tree
    i, q = np.tile(np.arange(n), 2), np.concatenate(roots)
    sound = (i + q <= n) & (periods * q <= n)
    i, q = i[sound], q[sound]
    forward = common_extensions(depths, place, i, i + q)  # the suffix at n is the closing symbol
    depths, place, _ = SuffixTree(list(symbols)[::-1]).tour(1)
    back = common_extensions(depths, place, n - i, n - i - q)  # of the words before i and before i + q
    start, length = i - back, back + q + forward
    good = length >= np.maximum(least, periods * q)
    found = np.unique(np.stack([start[good], length[good], q[good]], axis=1), axis=0)
    return [tuple(r) for r in found[np.lexsort((found[:, 2], found[:, 0]))].tolist()]


# -- where runs can be ---------------------------------------------------------------------------------------------------------
def _stretches(places: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` places the size of the stretch of consecutive ``places`` that it lies in, or 0."""
    has = np.zeros(n + 2, np.int8)
    has[places + 1] = 1
    edge = np.flatnonzero(np.diff(has))
    size = np.zeros(n, np.int64)
    size[has[1:-1] == 1] = np.repeat(edge[1::2] - edge[::2], edge[1::2] - edge[::2])
    return size


def chains(words: Sequence[bytes], least: int, periods: int) -> list[tuple[int, int]]:
    """Disjoint stretches ``[start, end)`` such that every run asked for lies in one.

    A run of length L and period q agrees with itself over L - q words at distance q, and L - q is at least ``width``; so each of its
    first m = L - q - width + 1 groups of ``width`` words comes again within q, each of its last m groups came before within q, and
    (periods - 1) * q is at most m + width - 1. Neighbouring equal groups that are further apart than the stretches of such groups at
    either end allow are no part of a run; the others chain up to stretches of the text.
    """
    n = len(words)
    width = max(1, -(-least * (periods - 1) // periods))
    if n < max(least, 2):
        return []
    if n >= len(_cache["power"]):
        _cache["power"] = np.cumprod(np.full(2 * n, _ODD))
        _cache["inverse"] = np.cumprod(np.full(2 * n, _INVERSE))
    value = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _cache["power"][:n])])
    groups = (sums[width:] - sums[:-width]) * _cache["inverse"][: n - width + 1]
    order = np.argsort(groups, kind="stable")
    same = groups[order[1:]] == groups[order[:-1]]
    first, then = order[:-1][same], order[1:][same]
    while len(first):
        room = np.maximum(_stretches(first, len(groups))[first], _stretches(then, len(groups))[then])
        fits = (periods - 1) * (then - first) <= room + width - 1
        if fits.all():
            break
        first, then = first[fits], then[fits]
    if not len(first):
        return []
    by = np.argsort(first)
    first, reach = first[by], np.maximum.accumulate(then[by] + width)
    new = np.concatenate([[True], first[1:] >= reach[:-1]])
    ends = reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(first) - 1]])]
    return [(a, b) for a, b in zip(first[new].tolist(), ends.tolist()) if b - a >= least]


_cache = {"power": np.cumprod(np.full(1 << 12, _ODD)), "inverse": np.cumprod(np.full(1 << 12, _INVERSE))}


def runs(words: Sequence[bytes], least: int = 24, periods: int = 3) -> list[Run]:
    """All runs of a list of words, ``(start, length, period)`` by start, then period."""
    out = []
    for a, b in chains(words, least, periods):
        names: dict[bytes, int] = {}
        symbols = [names.setdefault(w, len(names)) for w in words[a:b]]
        out += [(a + s, n, q) for s, n, q in runs_in(symbols, least, periods)]
    return out


def strongest(found: Sequence[Run]) -> Run | None:
    """The run with the greatest length/period, compared exactly; of equal ones the first, then the one with the smaller period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: Sequence[bytes], found: Sequence[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return list(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, [s + q for s, _, q in found], 1)
    np.add.at(change, [s + n for s, n, _ in found], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


# -- over documents ------------------------------------------------------------------------------------------------------------
FIELDS = [
    ("n_runs", "long"), ("start", "long"), ("length", "long"), ("period", "long"), ("exponent_milli", "long"), ("runs", "string"), ("runs_sha256", "string"),
    ("collapsed_sha256", "string"),
]


def periodic_runs(
    docs: DataFrame, least: int = 24, periods: int = 3, doc_id: str = "doc_id", text: str = "text",
    change: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``doc_id`` and ``FIELDS`` of every row: a map without a shuffle.

    ``runs`` lists each run as ``start,length,period`` and a line feed, by start, then period; ``runs_sha256`` is its hash, and
    ``collapsed_sha256`` that of the words left, joined by blanks. ``start`` to ``exponent_milli`` describe the strongest run and are null
    without one. ``change`` may alter a document's words first, given its id. Null, empty and blank texts have no words; repeated rows come
    out once each; other columns are not read. ``periods`` is at least 2. Memory grows with the longest stretch of repetition in a text.
    """
    if periods < 2:
        raise ValueError("a run repeats its period at least once")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def row(ident, text) -> tuple:
        words = words_of(text)
        if change is not None:
            words = change(ident, words)
        found = runs(words, least, periods)
        top = strongest(found)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        numbers = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        return len(found), *numbers, told, sha(told.encode()), sha(b" ".join(collapsed(words, found)))

    return map_rows(source, row, FIELDS)


def tail_repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Documents whose id's CRC-32 ends in 0 repeat a stretch of their own words to their end; null ids are left alone."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // len(unit)))[: n - a]
