"""Exact quantiles per group that survive a group holding most of the rows.

Spark's ``percentile`` keeps every distinct value of a group in one task. Here an approximate sketch (bounded size) first brackets each
quantile. Where the bracket of a large group can still hold more than ``BAND`` values, the rows in it are counted in ``BUCKETS`` equal
parts, which combines on the map side, and the bracket shrinks to the parts that hold the wanted ranks; this repeats until no bracket
is that large. Rows outside are only counted, and the exact order statistics are read from a list of at most about ``BAND`` values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import materialize

ACCURACY = 10_000
BAND, BUCKETS = 20_000, 1024


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition &= left[k].eqNullSafe(right[k])
    return condition


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match null keys."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition &= left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def _in_bracket(rows: DataFrame, fences: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the brackets of their group, and on which side of each they are."""
    side = F.when(F.col("__v") < F.col("__low"), -1).when(F.col("__v") > F.col("__high"), 1).otherwise(0)
    return join_null_safe(rows, fences, by, "inner").withColumn("__side", side)


def _ranks() -> tuple[Column, Column]:
    """Positions, from 1, of the two values between which a quantile lies."""
    rank = F.floor((F.col("__n") - 1) * F.col("__p")) + 1
    return rank, F.least(rank + 1, F.col("__n"))


def _narrowed(rows: DataFrame, fences: DataFrame, by: list[str]) -> DataFrame:
    """Each bracket cut down to the parts that hold its two ranks; ``__most`` is how many different values it can hold."""
    width = F.col("__high") / 2 - F.col("__low") / 2
    part = F.when(width > 0, F.least(F.floor((F.col("__v") / 2 - F.col("__low") / 2) / width * BUCKETS), F.lit(BUCKETS - 1))).otherwise(0)
    one = [*by, "__q", "__p", "__n", "__low", "__high"]
    placed = _in_bracket(rows, fences, by).where("__side <= 0").withColumn("__part", F.when(F.col("__side") < 0, -1).otherwise(part).cast("int"))
    counted = placed.groupBy(*one, "__part").agg(F.count("*").alias("c"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    parts = counted.groupBy(*one).agg(F.array_sort(F.collect_list(F.struct("__part", "c", "low", "high"))).alias("__parts"))  # BUCKETS + 1 at most
    first, second = _ranks()
    start = F.struct(F.lit(0).cast("long").alias("end"), *[F.lit(None).cast("double").alias(c) for c in ("low", "high")], F.lit(0).cast("long").alias("most"))

    def step(acc: Column, e: Column) -> Column:
        end = acc["end"] + e["c"]
        holds = lambda r: (acc["end"] < r) & (r <= end)
        both = holds(first) & holds(second)
        # in different parts the first rank is its part's last value and the second its part's first
        return F.struct(
            end.alias("end"), F.when(holds(first), F.when(both, e["low"]).otherwise(e["high"])).otherwise(acc["low"]).alias("low"),
            F.when(holds(second), F.when(both, e["high"]).otherwise(e["low"])).otherwise(acc["high"]).alias("high"),
            F.when(both, F.when(e["low"] == e["high"], 1).otherwise(e["c"])).otherwise(acc["most"]).alias("most"),
        )

    cut = parts.select(*one, F.aggregate("__parts", start, step).alias("__a"))
    low, high = F.col("__a.low"), F.col("__a.high")
    # a bracket with an infinite end can't be cut into equal parts
    most = F.when((low == F.col("__low")) & (high == F.col("__high")), 0).otherwise(F.col("__a.most")).alias("__most")
    return cut.select(*by, "__q", "__p", "__n", low.alias("__low"), high.alias("__high"), most)


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with linearly interpolated quantiles; nulls in ``value`` do not count, null keys form groups.

    The sketch is computed when this is called, and further rounds of counts for groups of more than about ``BAND * ACCURACY / 4`` rows.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    if not keys:
        rows = rows.withColumn("__all", F.lit(0))
    by = keys or ["__all"]
    margin = 2.0 / ACCURACY
    fractions = [f for p in probs.values() for f in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = rows.groupBy(*by).agg(
        F.count("*").alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__largest"),
        F.percentile_approx("__v", F.array(*[F.lit(f) for f in fractions]), ACCURACY).alias("__f"),
    )
    each = [
        F.struct(F.lit(q).alias("__q"), F.lit(p).alias("__p"), F.element_at("__f", 2 * i + 1).alias("__low"), F.element_at("__f", 2 * i + 2).alias("__high"))
        for i, (q, p) in enumerate(probs.items())
    ]
    sketch = materialize(sketch, "sketch")
    fences = sketch.select(*by, "__n", "__least", "__largest", F.explode(F.array(*each)).alias("__b")).select(*by, "__b.__q", "__b.__p", "__n", "__b.__low", "__b.__high", "__least", "__largest")
    wide = F.col("__n") * 4 / ACCURACY > BAND
    fences = fences.withColumn("__most", F.when(wide, F.col("__n")).otherwise(0))
    if (sketch.agg(F.max("__n")).first()[0] or 0) * 4 / ACCURACY > BAND:
        done, open_ = fences.where(~wide).drop("__least", "__largest"), fences.where(wide)
        # a sketch is only probably right: large groups start from their whole range
        open_ = materialize(open_.select(*by, "__q", "__p", "__n", F.col("__least").alias("__low"), F.col("__largest").alias("__high"), "__most"), "fences")
        while not open_.isEmpty():
            cut = materialize(_narrowed(rows, open_, by), "fences")
            done = done.unionByName(cut.where(F.col("__most") <= BAND))
            open_ = cut.where(F.col("__most") > BAND)
        fences = done
    fences = fences.select(*by, "__q", "__p", "__n", "__low", "__high")
    if not keys:
        fences = F.broadcast(fences)  # one row per requested quantile
    one = [*by, "__q", "__p", "__n"]
    banded = _in_bracket(rows, fences, by).groupBy(*one, "__side", F.when(F.col("__side") == 0, F.col("__v")).alias("__band")).agg(
        F.count("*").alias("c"), F.min("__v").alias("__min"), F.max("__v").alias("__max")
    )
    # Below the bracket only the last rank is known, above it only the first: the band's neighbours.
    at = F.when(F.col("__side") < 0, F.col("__max")).otherwise(F.col("__min")).alias("at")
    listed = banded.groupBy(*one).agg(F.array_sort(F.collect_list(F.struct(F.col("__side").alias("side"), at, "c"))).alias("__list"))
    first, second = _ranks()
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))

    def step(acc: Column, e: Column) -> Column:
        end = acc["end"] + e["c"]
        low = F.when(e["side"] < 0, end).otherwise(acc["end"] + 1)
        high = F.when(e["side"] > 0, low).otherwise(end)
        pick = lambda r, was: F.when((low <= r) & (r <= high), e["at"]).otherwise(was)
        return F.struct(end.alias("end"), pick(first, acc["lo"]).alias("lo"), pick(second, acc["hi"]).alias("hi"))

    position = (F.col("__n") - 1) * F.col("__p")
    stats = listed.select(*one, F.aggregate("__list", start, step).alias("__a"), (position - F.floor(position)).alias("__t"))
    lo, hi, t = F.col("__a.lo"), F.col("__a.hi"), F.col("__t")
    # Halfway is the plain mean of the two middle values.
    between = F.when(t == 0.5, (lo + hi) / 2).when(t < 0.5, lo + (hi - lo) * t).otherwise(hi - (hi - lo) * (1 - t))
    out = stats.groupBy(*by).agg(*[F.max(F.when(F.col("__q") == q, between)).alias(q) for q in probs])
    return out if keys else out.drop("__all")
