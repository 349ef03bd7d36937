"""Ranks, keep-first / keep-last and top rows without single-task windows over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.session import materialize


def competition_rank(df: DataFrame, score: str, name: str) -> DataFrame:
    """1 = highest, ties share the lowest rank; null scores have none.

    Rows are counted per score, which combines before the shuffle, and the different scores are range-sorted: a score's rank is the rows
    of the parts before its own and those above it in its part. Each score is in one part, so ties need no further care.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("__score")).agg(F.count("*").alias("__c"))
    ordered = materialize(counts.orderBy(F.desc("__score")).withColumn("__part", F.shiftright(F.monotonically_increasing_id(), 33)), "scores")
    above = Window.partitionBy("__part").orderBy(F.desc("__score")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy("__part").agg(F.sum("__c").alias("__rows"))
    offsets = F.broadcast(sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before")))  # one row per part of the sort
    rank = (F.col("__before") + F.coalesce(F.sum("__c").over(above), F.lit(0)) + 1).alias(name)
    ranks = materialize(ordered.join(offsets, "__part").select("__score", rank), "ranks")
    return df.join(ranks, df[score] == ranks["__score"], "left").drop("__score")


def sequence_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1..n over all rows: a range sort, then each partition is shifted by the rows before it.

    The sorted rows are materialised because both passes must see the same partitions, and the rows before them because a range
    sort reads its input twice.
    """
    spot = F.monotonically_increasing_id()
    ordered = materialize(materialize(df, "unsorted").orderBy(*order).withColumn("__spot", spot), "sorted")
    part, place = F.shiftright("__spot", 33), F.col("__spot").bitwiseAND(F.lit((1 << 33) - 1))
    ordered = ordered.select("*", part.alias("__part"), place.alias("__place"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("__c"))
    offsets = sizes.select("__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    # one row per partition of the sort
    ranked = ordered.join(F.broadcast(offsets), "__part")
    return ranked.withColumn(name, F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__before", "__spot")


def top_rows(df: DataFrame, order: list[Column], n: int, name: str | None = None) -> DataFrame:
    """First ``n`` rows in order, numbered when ``name`` is given; ``n`` is the report's length."""
    top = df.orderBy(*order).limit(n)
    return top if name is None else top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def top_in_row(values: dict[str, Column], n: int) -> Column:
    """Names of a row's ``n`` largest values, largest first and equal ones by name; nulls are left out."""
    entries = [F.when(v.isNotNull(), F.struct((-v).alias("m"), F.lit(name).alias("n"))) for name, v in values.items()]
    return F.transform(F.slice(F.array_sort(F.array_compact(F.array(*entries))), 1, n), lambda x: x["n"])


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the row that is last in ``order``; an aggregate, so repeats combine before the shuffle."""
    return _keep(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _keep(df, keys, order, F.min_by)


def _keep(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order, *rest)).alias("__row"))
    return kept.select(*keys, "__row.*")
