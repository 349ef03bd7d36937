"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, and every segment value is a bucket of about ``BUCKET`` codes. A query probes the buckets whose value is
at exactly ``radius`` bits from its own segment; after a radius each code nearer than ``segments * (radius + 1)`` bits has been met.
Buckets and the queries that probe them are cut into blocks, which meet by equality of segment and value in a shuffled join; of a
block each query keeps its ``k + 1`` nearest codes only. A query ends once its k-th verified distance is covered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.session import materialize

BITS = 64
#: Codes that a bucket holds where codes are spread evenly, and the most codes or queries in a block.
BUCKET, BLOCK = 256, 2048


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """A long whose bit i says whether component i is above zero; missing or null components are zero, a null vector has no code."""
    ones = F.transform(F.slice(vector, 1, bits), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0)))
    return F.aggregate(ones, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def segments(rows: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment: wide enough for about ``BUCKET`` codes in a bucket, so that few probes meet many codes."""
    count = max(2, min(16, round(BITS / max(1.0, math.log2(max(2, rows / BUCKET))))))
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(code: Column, at: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(code, at[0]).bitwiseAND(F.lit((1 << at[1]) - 1))


def _cells(rows: DataFrame, cut: list[tuple[int, int]], code: str) -> DataFrame:
    """``rows`` once for each segment, with the segment's number ``s`` and ``value``."""
    pieces = F.array(*[F.struct(F.lit(s).alias("s"), _segment(F.col(code), at).alias("value")) for s, at in enumerate(cut)])
    return rows.select("*", F.explode(pieces).alias("at")).select("at.s", "at.value", *rows.columns)


def _flips(spark: SparkSession, cut: list[tuple[int, int]], radius: int) -> DataFrame:
    """``s, flip``: the masks of ``radius`` bits of each segment, grown bit by bit."""
    out = []
    for s, (_, width) in enumerate(cut):
        masks = spark.range(1).select(F.lit(0).cast("long").alias("flip"), F.lit(-1).alias("top"))
        for _ in range(radius):
            up = masks.select("flip", F.explode(F.sequence(F.col("top") + 1, F.lit(width))).alias("top")).where(F.col("top") < width)
            masks = up.select(F.col("flip").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("top"))).alias("flip"), "top")
        out.append(masks.select(F.lit(s).alias("s"), "flip"))
    return reduce(DataFrame.union, out)


def _probes(active: DataFrame, cut: list[tuple[int, int]], radius: int) -> DataFrame:
    """``s, value, q, bound``: every segment value at exactly ``radius`` bits from each query's."""
    rows = _cells(active, cut, "q")
    if not radius:
        return rows.select("s", "value", "q", "bound")
    flips = _flips(active.sparkSession, cut, radius).groupBy("s").agg(F.collect_list("flip").alias("flips"))
    # at most 16 rows, with the masks of a segment: their number depends on its width only
    made = rows.join(F.broadcast(materialize(flips, "flips")), "s").select("s", "value", "q", "bound", F.explode("flips").alias("flip"))
    return made.select("s", F.col("value").bitwiseXOR(F.col("flip")).alias("value"), "q", "bound")


def _blocked(rows: DataFrame, row: str, values: list[str], name: str) -> DataFrame:
    """``s, value, <name>_rows``: each bucket's rows as lists of about ``BLOCK`` rows at most."""
    sizes = rows.groupBy("s", "value").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("lists")).where("lists > 1")
    dealt = rows.join(materialize(sizes, "crowded").hint("merge"), ["s", "value"], "left")
    block = F.pmod(F.xxhash64(row), F.coalesce("lists", F.lit(1))).cast("int")
    lists = dealt.withColumn("block", block).groupBy("s", "value", "block").agg(F.collect_list(F.struct(*values)).alias(f"{name}_rows"))
    return materialize(lists.drop("block"), name)


def _nearest(k: int):
    """Of each two lists that meet, every query's ``k`` nearest codes within its bound, the ones with smaller least ids first."""

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = lambda v, c: v.field(c).to_numpy(zero_copy_only=False)
        for x in parts:
            for i in range(x.num_rows):
                asked, held = (x.column(c)[i].values for c in ("probe_rows", "cell_rows"))
                q, bound, code, n, least = field(asked, "q"), field(asked, "bound"), *(field(held, c) for c in ("code", "n", "least"))
                order = np.argsort(least, kind="stable")
                code, n, least = code[order], n[order], least[order]
                for at in range(0, len(q), 256):
                    apart = np.bitwise_count((q[at : at + 256, None] ^ code[None, :]).view(np.uint64))
                    near = apart.astype(np.int64) * len(code) + np.arange(len(code))
                    if len(code) > k:
                        near = np.partition(near, k - 1, axis=1)[:, :k]
                    r, c = np.nonzero(near // len(code) <= bound[at : at + 256, None])
                    distance, p = near[r, c] // len(code), near[r, c] % len(code)
                    columns = [q[at + r], code[p], n[p], least[p], distance.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["q", "code", "n", "least", "distance"])

    return of


def _kept(found: DataFrame, need: int) -> DataFrame:
    """Each query's ``need`` nearest different codes."""
    by = Window.partitionBy("q").orderBy("distance", "least", "code")
    return found.distinct().withColumn("place", F.row_number().over(by)).where(F.col("place") <= need).drop("place")


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, id, distance, rank``: for each row of ``queries`` (``query_id, code``) the ``k`` rows of ``codes``
    (``id, code``) with the smallest Hamming distance, smaller ids first; the query's own id is left out.

    Codes are 64-bit longs, ids are numbers. Exact: a code not yet met differs by at least ``radius + 1`` bits in every segment, so after a
    radius all distances below ``segments * (radius + 1)`` are complete, and a query ends once its ``k + 1`` nearest rows are that near.
    Equal codes are indexed once with their number and smallest id, so copies cost nothing. Null codes and ids are left out; repeated
    query rows come out once; with fewer than k other rows, all are returned. Other columns are not read.

    What is kept of a round is at most ``k + 1`` codes for each query and bucket block met, and after it ``k + 1`` for each query.
    """
    known = codes.where("code is not null and id is not null").select("code", F.col("id").cast("long").alias("id"))
    wanted = queries.where("code is not null and query_id is not null").select("query_id", F.col("code").alias("q")).distinct()
    classes = materialize(known.groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("least")), "codes")
    rows, total = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not rows:
        return wanted.limit(0).select("query_id", F.col("query_id").alias("id"), F.lit(0).alias("distance"), F.lit(0).alias("rank"))
    cut, need = segments(rows), min(k + 1, total)
    cells = _blocked(_cells(classes, cut, "code"), "code", ["code", "n", "least"], "cell")
    active = wanted.select("q").distinct().withColumn("bound", F.lit(BITS))
    found = classes.limit(0).select(F.col("code").alias("q"), "code", "n", "least", F.lit(0).alias("distance"))
    for radius in range(max(w for _, w in cut) + 1):
        active = materialize(active, "active")
        if active.isEmpty():
            break
        held = cells.select("s", "value").distinct().hint("merge")
        probes = _blocked(materialize(_probes(active, cut, radius).join(held, ["s", "value"], "left_semi"), "met"), "q", ["q", "bound"], "probe")
        # a bucket of many codes, or one that many queries ask for, is spread over its pairs of lists
        pairs = probes.join(cells.hint("merge"), ["s", "value"]).select("probe_rows", "cell_rows")
        new = pairs.mapInArrow(_nearest(need), "q long, code long, n long, least long, distance int")
        found = materialize(_kept(found.union(new), need), "found")
        upto = F.sum("n").over(Window.partitionBy("q").orderBy("distance").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        reach = found.withColumn("upto", upto).where(F.col("upto") >= need).groupBy("q").agg(F.min("distance").alias("reach"))
        covered = len(cut) * (radius + 1) - 1
        left = active.join(materialize(reach, "reach"), "q", "left").where(F.coalesce(F.col("reach") > covered, F.lit(True)))
        active = left.select("q", F.coalesce("reach", "bound").alias("bound"))
    # of a code with many rows the k + 1 smallest ids are enough
    smallest = known.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("place") <= k + 1)
    members = found.select("q", "code", "distance").join(smallest.select("code", "id"), "code")
    by = Window.partitionBy("q").orderBy("distance", "id")
    ranked = materialize(members.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k + 1).select("q", "id", "distance"), "ranked")
    out = materialize(wanted, "wanted").join(ranked.hint("merge"), "q").where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "distance", "rank")
