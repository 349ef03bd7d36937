"""Joins on keys of which a few may hold a large share of the rows.

A key with more rows than ``BLOCK`` is cut into blocks by a hash of the row id.  A join then compares
block with block, so no task sees more than two blocks; every pair still meets exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 2000


def hot_keys(df: DataFrame, keys: list[str], name: str, size: int = BLOCK) -> DataFrame:
    """The keys with more than ``size`` rows and into how many blocks they are cut: at most one key per ``size`` rows."""
    hot = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > size)
    return hot.select(*keys, F.ceil(F.col("__n") / size).cast("int").alias(name))


def with_blocks(df: DataFrame, keys: list[str], row_id: Column, size: int = BLOCK) -> DataFrame:
    """Add ``__blocks`` (how many the row's key has) and ``__block``."""
    blocks = F.coalesce("__blocks", F.lit(1))
    return df.join(hot_keys(df, keys, "__blocks", size), keys, "left").withColumns(
        {"__blocks": blocks, "__block": F.pmod(F.xxhash64(row_id), blocks).cast("int")}
    )


def blocked_pairs(df: DataFrame, keys: list[str], row_id: str, values: list[str], size: int = BLOCK) -> DataFrame:
    """Unordered pairs of different rows with equal keys: ``<value>_a``, ``<value>_b`` with ``row_id_a < row_id_b``."""
    cut = with_blocks(df, keys, F.col(row_id), size)
    columns = [row_id, *values]
    side = lambda suffix: [F.col(c).alias(f"__{suffix}_{c}") for c in columns]
    left = cut.select(*keys, *side("l"), F.col("__block").alias("__i"), F.explode(F.sequence("__block", F.col("__blocks") - 1)).alias("__j"))
    right = cut.select(*keys, *side("r"), F.explode(F.sequence(F.lit(0), "__block")).alias("__i"), F.col("__block").alias("__j"))
    l_id, r_id = F.col(f"__l_{row_id}"), F.col(f"__r_{row_id}")
    met = left.join(right, [*keys, "__i", "__j"]).filter((F.col("__i") < F.col("__j")) | (l_id < r_id))
    forward = l_id < r_id
    ordered = []
    for c in columns:
        l, r = F.col(f"__l_{c}"), F.col(f"__r_{c}")  # noqa: E741
        ordered += [F.when(forward, l).otherwise(r).alias(f"{c}_a"), F.when(forward, r).otherwise(l).alias(f"{c}_b")]
    return met.select(*keys, *ordered)


def blocked_lookup(left: DataFrame, right: DataFrame, keys: list[str], right_id: Column, size: int = BLOCK) -> DataFrame:
    """Inner join in which both sides of a hot key are cut into blocks and each block meets every block of the other side.

    However many rows either side has for a key, a task sees one block of each.
    """
    own, others = hot_keys(left, keys, "__rows", size), hot_keys(right, keys, "__cols", size)
    rows, cols = F.coalesce("__rows", F.lit(1)), F.coalesce("__cols", F.lit(1))
    block = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    one = left.join(own, keys, "left").join(others, keys, "left").withColumn("__i", block(F.struct(*left.columns), rows)).withColumn("__j", every(cols))
    two = right.join(others, keys, "left").join(own, keys, "left").withColumn("__j", block(right_id, cols)).withColumn("__i", every(rows))
    return one.drop("__rows", "__cols").join(two.drop("__rows", "__cols"), [*keys, "__i", "__j"]).drop("__i", "__j")
