"""Near-equal 64-bit hashes: which projects submitted the same item.

Equal hashes are collapsed first.  Two hashes that differ in at most ``d`` bits agree in at least
``bands - d`` of ``bands`` bit groups, so every combination of that many groups is a join key; with 8
bands and 5 bits a key has 24 bits.  Hashes that crowd a key are cut again: their other bits form as many
groups, of which two near ones agree in as many, so a second key is added from those; this loses no pair.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import rounded
from ledgerlens.operators.blocking import blocked_pairs, hot_keys

#: More hashes with one key are cut again by other bits.
CROWD = 1000


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def band_keys(item_hash: str, distance: int, bands: int = 8) -> Column:
    """Array of (combination number, agreed bits) keys."""
    width = 64 // bands
    group = [F.shiftrightunsigned(item_hash, width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(bands)]
    keys = [F.struct(F.lit(n).alias("c"), F.xxhash64(*[group[i] for i in chosen]).alias("k"))
            for n, chosen in enumerate(combinations(range(bands), bands - distance))]
    return F.array(*keys)


def finer_masks(spark: SparkSession, distance: int, bands: int = 8) -> DataFrame:
    """``__c, masks``: for each combination of ``band_keys``, which of its free bits to compare; one mask for each choice of groups of them."""
    width, rows = 64 // bands, []
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    for n, chosen in enumerate(combinations(range(bands), bands - distance)):
        free = [p for i in range(bands) if i not in chosen for p in range(width * i, width * i + width)]
        edges = [len(free) * i // bands for i in range(bands + 1)]
        groups = [sum(1 << p for p in free[a:b]) for a, b in zip(edges, edges[1:])]
        rows.append((n, [signed(sum(groups[i] for i in picked)) for picked in combinations(range(bands), bands - distance)]))
    return spark.createDataFrame(rows, "__c int, masks array<long>")


def distinct_hashes(items: DataFrame, by: list[str]) -> DataFrame:
    return items.groupBy(*by, "item_hash").agg(
        F.count("*").alias("items"), F.min("project_id").alias("first_project"), F.max("project_id").alias("last_project"),
        F.min("item_id").alias("first_item"),
    )


def _near(hashes: DataFrame, by: list[str], distance: int, bands: int) -> DataFrame:
    values = ["items", "first_project", "last_project", "first_item"]
    keyed = hashes.select(*by, "item_hash", *values, F.explode(band_keys("item_hash", distance, bands)).alias("__k"))
    keyed = keyed.select(*by, "item_hash", *values, F.col("__k.c").alias("__c"), F.col("__k.k").alias("__key"))
    key = [*by, "__c", "__key"]
    marked = keyed.join(hot_keys(keyed, key, "__n", CROWD), key, "left")
    masks = F.broadcast(finer_masks(hashes.sparkSession, distance, bands))  # a row for each combination of bands
    again = marked.filter("__n is not null").drop("__n").join(masks, "__c").withColumn("__mask", F.explode("masks")).drop("masks")
    again = again.withColumn("__key2", F.col("item_hash").bitwiseAND(F.col("__mask")))
    columns = [f"{c}_{s}" for c in ("item_hash", *values) for s in ("a", "b")]
    few = blocked_pairs(marked.filter("__n is null").drop("__n"), key, "item_hash", values).select(*by, *columns)
    many = blocked_pairs(again, [*key, "__mask", "__key2"], "item_hash", values).select(*by, *columns)
    near = few.unionByName(many).withColumn("hamming", hamming(F.col("item_hash_a"), F.col("item_hash_b"))).filter(F.col("hamming") <= distance)
    return near.distinct()


def cross_project_duplicates(items: DataFrame, distance: int = 5, bands: int = 8) -> DataFrame:
    """Pairs of distinct hashes within ``distance`` bits that touch two projects, and hashes several projects share.

    Shared hashes pair with themselves at distance 0; item counts stand for the items behind a hash.
    """
    hashes = distinct_hashes(items, [])
    one_project = (F.col("first_project_a") == F.col("last_project_a")) & (F.col("first_project_b") == F.col("last_project_b"))
    apart = ~(one_project & (F.col("first_project_a") == F.col("first_project_b")))
    near = _near(hashes, [], distance, bands).filter(apart)
    shared = hashes.filter("first_project <> last_project")
    columns = ["item_hash", "items", "first_project", "first_item"]
    same = shared.select(*[F.col(c).alias(f"{c}_{s}") for s in ("a", "b") for c in columns], F.lit(0).alias("hamming"))
    both = near.select(*same.columns).unionByName(same)
    return both.withColumn("confidence", rounded(F.greatest(F.lit(0.0), 1 - F.col("hamming") / 64), 4))


def votes(distances: list[Column], limit: int = 5) -> Column:
    """Two of three hash kinds within the limit make a duplicate."""
    return sum(((d <= limit).cast("int") for d in distances), F.lit(0)) >= 2


def project_duplicates(items: DataFrame, distance: int = 5, bands: int = 8) -> DataFrame:
    """Per project: items, duplicate pairs among them, score min(1, pairs / items) and status."""
    hashes = distinct_hashes(items, ["project_id"])
    equal = hashes.groupBy("project_id").agg(
        F.sum("items").alias("items"), F.sum(F.col("items") * (F.col("items") - 1) / 2).alias("__equal")
    )
    near = _near(hashes, ["project_id"], distance, bands).groupBy("project_id").agg(
        F.sum(F.col("items_a") * F.col("items_b")).alias("__near")
    )
    pairs = (F.col("__equal") + F.coalesce("__near", F.lit(0))).cast("long")
    return equal.join(near, "project_id", "left").select(
        "project_id", "items", pairs.alias("duplicate_pairs"),
        F.least(F.lit(1.0), pairs / F.col("items")).alias("image_hash_score"),
        F.when(pairs > 0, "DUPLICATES_FOUND").otherwise("UNIQUE").alias("status"),
    )
