"""Mixing sources to target weights by temperature, with DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import materialize

GRID = 32
BUCKET_ROWS = 4096
BROADCAST_ROWS = 10_000


def word_count(text: Column) -> Column:
    """Words between white space, the default measure of tokens; 0 for null and blank texts."""
    inner = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return F.when(inner == "", F.lit(0)).otherwise(F.length(inner) - F.length(F.replace(inner, F.lit(" "), F.lit(""))) + 1).cast("long")


@dataclass(frozen=True)
class Mix:
    """What to aim at. ``repeat_limit``: no source is read more often than this. ``entropy``: instead, the mixture's entropy in
    nats is at least this. ``budget``: tokens in all; by default the smallest that takes every document at least once."""

    repeat_limit: float = 2.0
    entropy: float | None = None
    budget: int | None = None
    seed: int = 17


def _weights(shares: DataFrame, alphas: list[float]) -> DataFrame:
    """``alpha``, and over the sources the normaliser, entropy, smallest covering budget and largest repetition for each."""
    grid = F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha")
    each = shares.where("tokens > 0").select("tokens", "share", grid).withColumn("raw", F.pow("share", "alpha"))
    sums = each.groupBy("alpha").agg(
        F.sum("raw").alias("z"), F.sum(F.col("raw") * F.log("raw")).alias("zlog"), F.max(F.col("tokens") / F.col("raw")).alias("scarce"),
        F.max(F.col("raw") / F.col("tokens")).alias("keen"),
    )
    return sums.withColumns({"entropy": F.log("z") - F.col("zlog") / F.col("z"), "cover": F.col("scarce") * F.col("z")})


def exponent(shares: DataFrame, mix: Mix) -> float | None:
    """The exponent nearest to 0, the flattest mixture, that keeps within the repetition limit; with an entropy target, the
    exponent nearest to 1 that reaches it. ``None`` without any tokens.

    Repetition and entropy are monotone in the exponent, so the interval [0, 1] is cut again and again. Each job tests 32
    exponents, that is five bisections, on the per-source table; five jobs leave an interval of 3e-8. A target that
    neither end reaches gives the nearer end.
    """
    low, high = 0.0, 1.0
    for _ in range(5):
        step = (high - low) / GRID
        found = {r["alpha"]: r for r in _weights(shares, [low + i * step for i in range(GRID + 1)]).collect()}  # 33 rows
        if not found:
            return None
        alphas = sorted(found)
        if mix.entropy is not None:
            good = [a for a in alphas if found[a]["entropy"] >= mix.entropy]
            low = max(good, default=alphas[0])
            high = min((a for a in alphas if a > low), default=low)
            answer = low
        else:
            repeats = {a: r["keen"] / r["z"] * (mix.budget or r["cover"]) for a, r in found.items()}
            high = min((a for a in alphas if repeats[a] <= mix.repeat_limit * (1 + 1e-12)), default=alphas[-1])
            low = max((a for a in alphas if a < high), default=high)
            answer = high
        if low == high:
            break
    return answer


def row_place(seed: int, block: Column, doc_id: Column, row_hash: Column) -> Column:
    """A row's place in its source's permutation for a block: an unsigned 63-bit number."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), block.cast("long"), doc_id, row_hash), 1)


def plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """One row a source: ``source, tokens, share, weight, target, full, cut, n_docs``.

    ``rows`` has ``source, doc_id, row_hash, n_tokens``. A source is read in ``full`` whole blocks, each a permutation of its
    documents, and in one more block up to and with the place ``cut`` (null: not at all), the longest start of that block
    within the rest of its token budget. The cut is found from sums over buckets of places, then inside one bucket, so a
    source with any share of all rows is never sorted in one task.
    """
    sums = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    sums = materialize(sums, "source-sums")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.withColumn("share", F.col("tokens") / F.lit(float(max(1, total))))
    alpha = exponent(shares, mix)
    alpha = 1.0 if alpha is None else alpha
    norm = _weights(shares, [alpha]).first()
    z, cover = (norm["z"], norm["cover"]) if norm else (1.0, 0.0)
    weight = F.when(F.col("tokens") > 0, F.pow("share", F.lit(alpha)) / F.lit(z)).otherwise(0.0)
    target = F.round(weight * F.lit(float(cover if mix.budget is None else mix.budget))).cast("long")
    table = shares.withColumns({"weight": weight, "target": target})
    # a source without tokens costs nothing: each of its documents is taken once
    full = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(1).cast("long")
    table = materialize(
        table.withColumn("full", full).withColumns(
            {"rest": F.col("target") - F.col("full") * F.col("tokens"), "buckets": F.ceil(F.col("n_docs") / BUCKET_ROWS).cast("long")}
        ), "sources")
    placed = attach(rows.select("source", "doc_id", "row_hash", "n_tokens"), table.select("source", "full", "rest", "buckets").where("rest > 0"), "inner")
    placed = placed.withColumn("place", row_place(mix.seed, F.col("full"), F.col("doc_id"), F.col("row_hash")))
    placed = placed.withColumn("bucket", F.floor(F.col("place") / F.lit(float(1 << 63)) * F.col("buckets")).cast("long"))
    placed = placed.select("source", "rest", "bucket", "place", "n_tokens")
    by_bucket = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("size"), F.max("rest").alias("rest"), F.max("place").alias("last"))
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = materialize(by_bucket.withColumn("end", F.sum("size").over(so_far)), "buckets")
    whole = summed.where(F.col("end") <= F.col("rest")).select("source", F.col("last").alias("cut"))
    edge = summed.where((F.col("end") > F.col("rest")) & (F.col("end") - F.col("size") <= F.col("rest")))
    edge = edge.groupBy("source").agg(F.min_by("bucket", "bucket").alias("edge"), F.min_by(F.col("rest") - F.col("end") + F.col("size"), "bucket").alias("left"))
    inside = attach(placed.drop("rest"), edge, "inner").where(F.col("bucket") == F.col("edge"))
    inside = inside.groupBy("source", "left", "place").agg(F.sum("n_tokens").alias("size"))
    along = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = inside.withColumn("end", F.sum("size").over(along)).where(F.col("end") <= F.col("left")).select("source", F.col("place").alias("cut"))
    cuts = materialize(whole.union(start).groupBy("source").agg(F.max("cut").alias("cut")), "cuts")
    return attach(table.drop("rest", "buckets"), cuts, "left")


def attach(rows: DataFrame, per_source: DataFrame, how: str) -> DataFrame:
    """Join a per-source table, null sources included; sent to all tasks if it is counted to have at most 10,000 rows."""
    side = per_source.withColumnRenamed("source", "__source")
    side = F.broadcast(side) if per_source.count() <= BROADCAST_ROWS else side
    return rows.join(side, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def taken(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``rows`` once for each block that takes them, with ``block, place``; ``rows`` has ``source, doc_id, row_hash``."""
    met = attach(rows, sources.select("source", "full", "cut"), "inner")
    last = F.coalesce(row_place(seed, F.col("full"), F.col("doc_id"), F.col("row_hash")) <= F.col("cut"), F.lit(False))
    blocks = F.sequence(F.lit(0).cast("long"), F.col("full") - 1 + last.cast("long"))
    some = met.where((F.col("full") > 0) | last)
    out = some.withColumn("block", F.explode(blocks)).drop("full", "cut")
    return out.withColumn("place", row_place(seed, F.col("block"), F.col("doc_id"), F.col("row_hash")))


def mixed(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source", tokens: Column | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, block, place, weight``: the documents in the order ``block, place`` of the mixture.

    Every source gets the share of the tokens that the temperature gives it; it is read in block permutations, and only its
    last block is cut, to its budget. Rows are equal in ``place`` only if they have the same id and text; such repeated rows
    enter a block together. A null source is a source, a null text has no tokens, an empty table gives an empty one.
    ``tokens`` is the measure of a document, by default its words.
    """
    measure = word_count(F.col(text)) if tokens is None else tokens
    rows = docs.select(F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row_hash"), F.coalesce(measure, F.lit(0)).cast("long").alias("n_tokens"))
    rows = materialize(rows, "measured")
    sources = materialize(plan(rows, mix), "plan")
    out = taken(rows, sources, mix.seed)
    return attach(out, sources.select("source", "weight"), "inner").select("doc_id", "source", "n_tokens", "block", "place", "weight")


def mixed_rows(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs`` (columns ``doc_id, text, source`` and any others), each once for every block that takes it."""
    measured = docs.select("source", "doc_id", F.xxhash64("text").alias("row_hash"), word_count(F.col("text")).alias("n_tokens"))
    sources = materialize(plan(materialize(measured, "measured"), mix), "plan")
    keys = docs.select(F.struct(*docs.columns).alias("row"), "source", "doc_id", F.xxhash64("text").alias("row_hash"))
    return taken(keys, sources, mix.seed).select("row.*")
