"""SimHash near-duplicates, found through deletion-variant signatures.

Two fingerprints within ``max_bits = 3`` differ by at most one bit in one of their two halves (fewer segments than the usual
``max_bits + 1``). Each half is therefore indexed once for every position with that position wild: one differing bit leaves
one variant equal. Variants meet by equality, then the whole fingerprints are compared.

Work is on distinct fingerprints, so exact copies cost one row. A variant shared by more than ``bucket`` fingerprints isn't
compared in one task: its free bits are cut in two again, with a wildcard again, which is exact for the same reason and
ends at 10 free bits, that is at 1,024 fingerprints in a bucket, whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.arrow import add_columns
from ledgerlens.llm.components import components
from ledgerlens.session import materialize

SEED = 42
BITS = 64


def shingle_hashes(text: str | None, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle: lower-case A-Z, words between white space, ``width`` words joined by blanks, repeats included.

    Fewer words are one shingle, no words none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(words) - width + 1)].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are set in over half of the hashes; 0 without any."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of one text over shingles of ``width`` words; 0 for a text without words."""
    return majority(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fingerprint`` (signed long) of every row; null, empty and blank texts have fingerprint zero.

    Other columns are not read, so their names don't matter.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return add_columns(source, "text", lambda texts: [[fingerprint(t, width) for t in texts]], [("fingerprint", "long")]).drop("text")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


@lru_cache(1 << 12)
def _next_masks(fixed: int) -> np.ndarray:
    """Masks that fix, beside the bits of ``fixed``, one half of the free bits but for one wild bit."""
    free = [p for p in range(BITS) if not fixed >> p & 1]
    halves = free[: len(free) // 2], free[len(free) // 2 :]
    return np.array([_signed(fixed | sum(1 << p for p in half if p != wild)) for half in halves for wild in half], np.int64)


def _variants(rows: DataFrame, level: int) -> DataFrame:
    """``mask, value, fp`` for each wildcard; ``rows`` have ``fp`` and, below the first level, the ``mask`` fixed so far."""
    if level == 1:
        made = rows.select("fp", F.explode(F.array(*[F.lit(int(m)) for m in _next_masks(0)])).alias("mask"))
    else:

        def grown(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in parts:
                masks = [_next_masks(m & (1 << 64) - 1) for m in x["mask"].tolist()]
                sizes = [len(m) for m in masks]
                yield pd.DataFrame({"fp": np.repeat(x["fp"].to_numpy(), sizes), "mask": np.concatenate(masks) if masks else []}, dtype="int64")

        made = rows.mapInPandas(grown, "fp long, mask long")
    return made.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")


def _bucket_links(max_bits: int):
    """Each bucket's fingerprints, linked into trees: one link less than there are fingerprints in a connected part."""

    def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count((x ^ y).view(np.uint64))

    def trees(fps: np.ndarray) -> tuple[list[int], list[int]]:
        """Breadth-first trees, each from its best-connected fingerprint: the middle of a group links to all around it."""
        near = distance(fps[:, None], fps[None, :]) <= max_bits  # at most max(bucket, 1024) squared
        degree, a, b = near.sum(axis=1), [], []
        left = np.ones(len(fps), bool)
        while left.any():
            front = [int(np.where(left, degree, -1).argmax())]
            left[front[0]] = False
            for parent in front:  # grows while it is read
                children = np.flatnonzero(near[parent] & left)
                left[children] = False
                front += children.tolist()
                a += fps[children].tolist()
                b += [int(fps[parent])] * len(children)
        return a, b

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            pairs = x["fps"].map(len).to_numpy() == 2 if len(x) else np.zeros(0, bool)
            a, b = [], []
            if pairs.any():
                two = np.stack(x["fps"][pairs].to_list()).astype(np.int64)
                near = distance(two[:, 0], two[:, 1]) <= max_bits
                a, b = two[near].max(axis=1).tolist(), two[near].min(axis=1).tolist()
            for fps in x["fps"][~pairs]:
                more = trees(np.asarray(fps, np.int64))
                a, b = a + more[0], b + more[1]
            yield pd.DataFrame({"a": a, "b": b}, dtype="int64").drop_duplicates()

    return of


def links(fps: DataFrame, max_bits: int = 3, bucket: int = 512) -> DataFrame:
    """Links ``a, b`` between distinct values of ``fps.fp`` whose transitive closure is that of all pairs within ``max_bits``.

    ``max_bits`` is at most 3, for which two segments leave one bit to delete. Repeated values and nulls count once or not
    at all. Every pair within ``max_bits`` is connected through the result; pairs further apart never are by a link.
    """
    if max_bits > 3:
        raise ValueError("two segments with one wildcard each cover 3 bits")
    rows, found = fps.select("fp").where("fp is not null").distinct(), []
    for level in (1, 2, 3):  # 33, then 18, then 10 bits are free in a bucket
        # few bytes grow to many rows: spread them by count, not by size
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        made = _variants(rows, level)
        # from a file, so that the join deals out both sides itself and can split a hot bucket; sorted at every size
        shared = materialize(made.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1"), "shared")
        members = materialize(made.join(shared.hint("merge"), ["mask", "value"]), "variants")
        small = members if level == 3 else members.where(F.col("n") <= bucket)
        lists = small.groupBy("mask", "value").agg(F.collect_list("fp").alias("fps")).select("fps")
        found.append(materialize(lists.mapInPandas(_bucket_links(max_bits), "a long, b long").distinct(), "links"))
        rows = members.where(F.col("n") > bucket).select("fp", "mask").distinct()
        if level == 3 or rows.isEmpty():
            break
    return reduce(DataFrame.union, found)


def materialized_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``fingerprints``, written once to the shared folder: 16 bytes a row, read by every later step."""
    return materialize(fingerprints(docs, doc_id, text, width), "fingerprints")


def near_groups(prints: DataFrame, max_bits: int = 3, bucket: int = 512) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for rows ``doc_id, fingerprint``.

    ``component_id`` is the smallest doc_id reachable over links of at most ``max_bits`` differing bits. Rows with equal
    fingerprints are linked; repeated rows come out once each. A null doc_id is never chosen unless its whole group has none.
    """
    classes = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select(F.col("fingerprint").alias("fp")), max_bits, bucket))
    rooted = classes.join(roots, classes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least"
    )
    rooted = materialize(rooted, "rooted")
    smallest = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    labels = rooted.join(smallest, "root").select("fingerprint", "component_id")
    return prints.join(labels, "fingerprint").select("doc_id", "fingerprint", "component_id")


# -- near copies by shingle similarity -----------------------------------------------------------------------------------------
# Fingerprints for shingle sets: each has 16 digits of 4 bits, one digit for each of 80 min-hashes, and is cut into two halves.
HASHES, DIGIT = 80, 15


def _multipliers(n: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)


_MULTIPLIERS = _multipliers(HASHES)
#: Digits of each segment. First the halves of the five fingerprints; then, for members of crowded variants only, longer segments
#: drawn from all digits, which unlike texts with much text in common share far more rarely.
LEVELS = [np.arange(HASHES).reshape(10, 8), np.stack([np.random.default_rng(SEED + i).permutation(HASHES)[:11] for i in range(24)])]


def _minima(hashes: np.ndarray) -> np.ndarray:
    """``HASHES`` min-hashes of 32 bits; all ones for a text without shingles."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 1 << 11):
        least = np.minimum(least, ((hashes[at : at + (1 << 11), None] * _MULTIPLIERS) >> np.uint64(32)).min(axis=0))
    return least.astype("<u4")


def _wild_keys(sketches: np.ndarray, level: int) -> np.ndarray:
    """One row of signed keys for each sketch: every segment once for every digit in it with that digit wild."""
    segments = LEVELS[level]
    weight = _multipliers(segments.size, SEED + 1 + level).reshape(segments.shape)
    name = _multipliers(segments.size, SEED + 11 + level).reshape(segments.shape)
    part = (sketches[:, segments] & DIGIT).astype(np.uint64) * weight
    return (part.sum(axis=2, keepdims=True) - part + name).reshape(len(sketches), -1).view(np.int64)


def _sketch(minima: np.ndarray) -> bytes:
    """The low 16 bits of each min-hash: also in long texts two different ones are equal once in 65,536 only."""
    return minima.astype("<u2").tobytes()


def _lowest(similarity: float) -> int:
    """So many equal values of two sketches are four standard errors below ``similarity``."""
    return math.floor(HASHES * similarity - 4 * math.sqrt(HASHES * similarity * (1 - similarity)))


def _jaccard(x: str | None, y: str | None, width: int) -> float:
    a, b = np.unique(shingle_hashes(x, width)), np.unique(shingle_hashes(y, width))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _with_both(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(side.select(F.col("node").alias(end), F.col(value).alias(f"{value}_{end}")), end)
    return pairs


def _checked(pairs: DataFrame, value: str, test: Callable[[list, list], list[bool]]) -> DataFrame:
    """The pairs whose two values pass the test."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts:
            keep = test(x.column(f"{value}_a").to_pylist(), x.column(f"{value}_b").to_pylist())
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b", f"{value}_a", f"{value}_b").mapInArrow(run, f"a {kind}, b {kind}")


def similar_pairs(rows: DataFrame, width: int = 5, similarity: float = 0.8, crowd: int = 2048) -> DataFrame:
    """Links ``a, b`` between different nodes of ``rows`` (``node, text``; equal nodes have equal texts) whose ``width``-word shingle
    sets are ``similarity`` alike; their transitive closure is that of all such pairs among the candidates.

    Texts whose SimHashes are at most 3 bits apart are candidates, found by the deletion variants of the SimHash (``links``). Edits that
    move more bits are found by deletion variants of finer signatures: five fingerprints of 16 digits over min-hashes of the shingles, each cut into two
    halves; a half is indexed once for each of its 8 digits with that digit wild, and variants meet by equality. Two texts that are J
    alike agree in a digit with probability g = J + (1 - J) / 16, whichever shingles differ, and are missed by all ten halves with
    probability (1 - g^8 - 8 g^7 (1 - g))^10: 0.0004 at 0.8 and less above. A sketch of the 80 min-hashes sorts out candidates
    more than four standard errors too far apart, and each remaining link is checked exactly on the whole texts.

    All members of a variant are first paired with one of them, another in each variant, so candidates grow with the rows. In
    variants whose members checked links leave in several components, all members of different components are compared in cells of
    bounded size, there by their shingles, and only links that hold are emitted, no more than connect the cell. Members of such variants of
    more than ``crowd`` texts (templates, text in common) are indexed again with longer segments instead; only what is crowded
    there too is compared in blocks whatever its size.
    """
    texts = materialize(rows.select("node", "text").groupBy("node").agg(F.first("text").alias("text")), "texts")
    marks = _marks(texts, width)
    found, rows_in = None, marks
    for level in range(len(LEVELS)):
        # from files, so that the join deals out both sides itself and can split a hot variant
        members = _members(rows_in, level)
        first = F.min(F.struct(F.xxhash64("node", "band").alias("order"), "node"))["node"]
        heads = materialize(members.groupBy("band").agg(F.count("*").alias("n"), first.alias("head")).where("n > 1"), "heads")
        met = materialize(members.join(heads.hint("merge"), "band"), "met")
        pairs = met.where("node != head").select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b"))
        pairs = (pairs if level else pairs.union(_print_pairs(texts))).distinct()
        checked = _alike(_close(pairs, marks, similarity), texts, width, similarity)
        found = checked if found is None else materialize(found.union(checked), "found")
        roots = materialize(components(found), "roots")
        named = met.where("n > 2").join(roots, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
        named = materialize(named, "named")
        split = named.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("band")
        crowds = materialize(named.join(materialize(split, "split").hint("merge"), "band", "left_semi"), "crowds")
        last = level + 1 == len(LEVELS)
        small = crowds if last else crowds.where(F.col("n") <= crowd)
        links = materialize(_cells(small.drop("n"), texts, width).mapInArrow(_cell_links(similarity), _pair_kind(marks)).distinct(), "links")
        found = materialize(found.union(_alike(links, texts, width, similarity)), "found")
        if last:
            return found
        again = crowds.where(F.col("n") > crowd).select("node").distinct()
        rows_in = materialize(marks.join(again, "node", "left_semi"), "again")
        if rows_in.isEmpty():
            return found


def _print_pairs(texts: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that connect all nodes whose SimHashes are equal or linked by at most 3 bits."""
    prints = materialized_fingerprints(texts, "node")
    heads = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("head")), "print-heads")
    found = prints.join(heads, "fingerprint").where("doc_id != head").select(F.col("doc_id").alias("x"), F.col("head").alias("y"))
    met = links(heads.select(F.col("fingerprint").alias("fp")))
    for end in ("a", "b"):
        met = met.join(heads.select(F.col("fingerprint").alias(end), F.col("head").alias(f"head_{end}")), end)
    found = found.union(met.select("head_a", "head_b"))
    return found.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def _members(marks: DataFrame, level: int) -> DataFrame:
    """``band, node`` for each one-wildcard variant of each row's segments."""
    kind = marks.schema["node"].dataType.simpleString()

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, 1024):
                x = whole.slice(at, 1024)
                keys = _wild_keys(np.stack([np.frombuffer(v, "<u2") for v in x.column("sketch").to_pylist()]), level)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * keys.shape[1], pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([x.column("node"), lists], names=["node", "bands"])

    return marks.select("node", "sketch").mapInArrow(of, f"node {kind}, bands array<long>").select(F.explode("bands").alias("band"), "node")


def _pair_kind(rows: DataFrame) -> str:
    kind = rows.schema["node"].dataType.simpleString()
    return f"a {kind}, b {kind}"


def _sets(texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node, shingles`` of some nodes: the sorted different shingle hashes, 32 bits each."""

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts:
            sets = [np.unique(shingle_hashes(t.as_py(), width).astype("<u4")).tobytes() for t in x.column("text")]
            yield pa.RecordBatch.from_arrays([x.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    kind = texts.schema["node"].dataType.simpleString()
    wanted = texts.join(nodes.distinct(), "node", "left_semi").select("node", "text")
    return materialize(wanted.mapInArrow(of, f"node {kind}, shingles binary"), "sets")


def _cells(named: DataFrame, texts: DataFrame, width: int, block: int = 256) -> DataFrame:
    """``x, who``: the members (``node, root, part, shingles``) of variants ``band, node, root`` with several components, so cut that each
    two members of different components are together in a cell of at most about twice ``block`` members.

    Blocks of the largest component (``part`` -1) meet blocks of the others; only where ``block`` members are outside the
    largest one do the blocks of the others (``x`` < 0) meet each other too.
    """
    sizes = named.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band")
    sizes = sizes.agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    sizes = sizes.select("band", F.col("main.root").alias("main"), blocks(F.col("main.n")).alias("mains"), blocks(F.col("n") - F.col("main.n")).alias("others"))
    met = named.join(materialize(sizes, "sizes").hint("merge"), "band").withColumn("inside", F.col("root") == F.col("main"))
    at = F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    met = met.withColumn("at", at)
    cell = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.transform(upto("others"), lambda y: cell(F.col("at"), y))
    across = F.transform(upto("mains"), lambda x: cell(x, F.col("at")))
    beside = F.transform(F.filter(upto("others"), lambda k: k != F.col("at")), lambda k: cell(-1 - F.least(k, "at"), F.greatest(k, "at")))
    met = met.select("band", "node", "root", F.when(F.col("inside"), -1).otherwise(F.col("at")).alias("part"), F.explode(F.when(F.col("inside"), own).otherwise(F.concat(across, beside))).alias("cell"))
    met = met.join(_sets(texts, named.select("node"), width), "node")
    return met.groupBy("band", "cell").agg(F.collect_list(F.struct("node", "root", "part", "shingles")).alias("who")).select("cell.x", "who")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarity of each two of the sets; 1 for two empty ones."""
    sizes = np.array([len(v) for v in sets], np.float32)
    values, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    shared = np.flatnonzero(times > 1)  # what one set alone has adds to no overlap
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    column = place[which]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for at in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        both += part @ part.T
    either = sizes[:, None] + sizes[None, :] - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0)


def _cell_links(similarity: float):
    """Links between members of different components in each cell that are alike, as few as connect them."""

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in parts:
            kind = cells.schema.field("who").type.value_type.field("node").type
            for x, who in zip(cells.column("x").to_pylist(), cells.column("who")):
                held = who.values
                node, part = held.field("node").to_pylist(), held.field("part").to_numpy()
                root = pd.factorize(held.field("root").to_pandas())[0]
                alike = _overlaps([np.frombuffer(v, "<u4") for v in held.field("shingles").to_pylist()])
                wanted = np.triu((alike >= similarity - 1e-6) & (root[:, None] != root[None, :]))
                # members outside the largest component meet in the first of its blocks, or in a cell of their two blocks
                outside = (part[:, None] >= 0) & (part[None, :] >= 0)
                if x:
                    wanted &= ~outside if x > 0 else part[:, None] != part[None, :]
                i, j = np.nonzero(wanted)
                # one link for each two components, then a forest over the components
                _, first = np.unique(np.minimum(root[i], root[j]) * len(node) + np.maximum(root[i], root[j]), return_index=True)
                above, ends = list(range(len(node))), []

                def top(c: int) -> int:
                    while above[c] != c:  # noqa: B023
                        above[c] = above[above[c]]  # noqa: B023
                        c = above[c]  # noqa: B023
                    return c

                for k, m in zip(i[first].tolist(), j[first].tolist()):
                    p, q = top(root[k]), top(root[m])
                    if p != q:
                        above[p] = q
                        ends.append((node[k], node[m]))
                if ends:
                    yield pa.RecordBatch.from_arrays([pa.array(list(map(max, ends)), kind), pa.array(list(map(min, ends)), kind)], names=["a", "b"])

    return of


def _marks(texts: DataFrame, width: int) -> DataFrame:
    """``node, sketch`` of each node, written once."""

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts:
            sketches = pa.array([_sketch(_minima(shingle_hashes(t.as_py(), width))) for t in x.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([x.column("node"), sketches], names=["node", "sketch"])

    kind = texts.schema["node"].dataType.simpleString()
    return materialize(texts.select("node", "text").mapInArrow(of, f"node {kind}, sketch binary"), "marks")


def _close(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sketches are not too far apart."""
    lowest = _lowest(similarity)

    def close(ones: list[bytes], others: list[bytes]) -> list[bool]:
        return [np.count_nonzero(np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)) >= lowest for x, y in zip(ones, others)]

    return materialize(_checked(_with_both(pairs, marks, "sketch"), "sketch", close), "screened")


def _alike(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose whole texts are alike; ``texts`` has one row for each node."""

    def alike(ones: list, others: list) -> list[bool]:
        return [_jaccard(t, u, width) >= similarity for t, u in zip(ones, others)]

    return _checked(_with_both(pairs, texts, "text"), "text", alike)


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group linked by ``similar_pairs`` the document with the smallest id stays.

    Equal texts are one class, linked at once; texts without words, null ones too, are alike. Repeated rows (same id and text) leave one; a
    null id is only kept where the group has no other. All columns come back unchanged.
    """
    keyed = docs.withColumn("__node", F.md5(F.coalesce(text, F.lit(""))))
    nodes = keyed.select(F.col("__node").alias("node"), F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    classes = materialize(nodes.groupBy("node").agg(F.min("id").alias("least")), "classes")
    roots = components(similar_pairs(nodes, width, similarity))
    rooted = classes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    kept = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("first"))
    kept = materialize(kept.select(F.col("first.node").alias("__kept"), F.col("first.least").alias("__least")), "kept")
    met = keyed.join(kept, (F.col("__node") == F.col("__kept")) & F.col(doc_id).eqNullSafe(F.col("__least")))
    return met.dropDuplicates(["__kept"]).select(docs.columns)
