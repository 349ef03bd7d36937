"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import materialize


def _star(edges: DataFrame, upward: bool) -> DataFrame:
    """Hang the larger (``upward``) or the smaller-or-equal neighbours of each node on the node's smallest neighbour.

    The smallest neighbour is an aggregate, so a node with very many links is combined before the shuffle; the join that
    follows reads it from a file and deals out both sides itself, so that adaptive execution can split a hot key.
    """
    if upward:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    met = both.join(least, "a")
    if upward:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges`` (columns ``a``, ``b`` of one ordered type) with its component's smallest node.

    Returns ``node, root``. Nulls, self-links and repeated links are ignored; an empty table gives an empty one. Large-star
    and small-star steps alternate until neither changes a link; a component of n nodes needs about log n rounds. The link
    table never grows, and each round is materialised in the shared folder. Raises if ``max_rounds`` don't suffice.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state = materialize(pairs.where(F.col("a") != F.col("b")).distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        state = materialize(_star(_star(state, True), False), "links")
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return state.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
