"""Project and MP features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.master import exact_sum, spend_ratio, vendor_lookup
from ledgerlens.operators.quantiles import group_quantiles, join_null_safe
from ledgerlens.schemas import FEATURE_COLUMNS, MP_COLUMNS
from ledgerlens.session import materialize

PEER_KEY = ["category", "state"]


def whole_days(start: Column, end: Column) -> Column:
    """Full days between two timestamps, rounded down."""
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 86_400).cast("long")


def cost_variation(final: Column, recommended: Column) -> Column:
    return F.when(recommended != 0, (final - recommended) / recommended * 100)


def peer_statistics(df: DataFrame, keys: list[str] = PEER_KEY, value: str = "recommended_amount") -> DataFrame:
    """Median, mean and sample deviation per peer group; null keys form a group.

    The amounts are written once, since three passes read them, and so are the statistics: their size is then known, and a
    table of few groups is joined without shuffling the rows that it is joined to.
    """
    df = materialize(df.select(*keys, value), "peer-amounts")
    mean = exact_sum(value) / F.count(value)
    stats = df.groupBy(*keys).agg(mean.alias("peer_mean_cost"), F.stddev_samp(value).alias("peer_std_cost"))
    return materialize(join_null_safe(stats, group_quantiles(df, keys, value, {"peer_median_cost": 0.5}), keys), "peers")


def with_peer_statistics(df: DataFrame, keys: list[str] = PEER_KEY, peers: DataFrame | None = None) -> DataFrame:
    """Peer statistics on every row; ``peers`` may come from a smaller table with the same amounts."""
    return join_null_safe(df, peer_statistics(df, keys) if peers is None else peers, keys)


def peer_deviation_pct(amount: Column, median: Column) -> Column:
    return F.try_divide(amount - median, median) * 100


def with_vendor_statistics(df: DataFrame, payments: DataFrame) -> DataFrame:
    # written first, as its size then decides how it is joined
    vendors = materialize(vendor_lookup(payments).withColumnRenamed("vendor", "primary_vendor"), "vendors")
    return df.join(vendors, "primary_vendor", "left")


def payment_features(df: DataFrame, compat_max_payment: bool = False) -> dict[str, Column]:
    """Average, extremes and frequency; ``compat_max_payment`` repeats total spend as both extremes."""
    some = F.col("payment_count") > 0
    total = F.col("total_expenditure")
    days = F.col("days_since_recommendation")
    out = {
        "average_payment": F.when(some, total / F.col("payment_count")),
        "payment_frequency": F.when(some & (days > 0), F.col("payment_count") / days),
    }
    if compat_max_payment or "maximum_payment" not in df.columns:
        whole = F.when(some, F.greatest(total, F.lit(0.0)))
        out |= {"maximum_payment": whole, "minimum_payment": whole}
    return out


def create_project_features(
    master: DataFrame,
    payments: DataFrame,
    as_of: str,
    similarity: DataFrame | None = None,
    compat_max_payment: bool = False,
    peers: DataFrame | None = None,
) -> DataFrame:
    """The 30 project features; ``similarity`` has project_id and description_similarity_score.

    Give ``peers = peer_statistics(works)`` to keep the peer groups from recomputing the master table.
    """
    recommended, final = F.col("recommended_amount"), F.col("final_amount")
    base = master.withColumns(
        {
            "is_completed": F.col("completed_date").isNotNull().cast("int"),
            "has_images": F.coalesce("has_images", F.lit(False)),
            "cost_variation_pct": cost_variation(final, recommended),
            "expenditure_ratio": spend_ratio(F.col("total_expenditure"), recommended, positive_only=False),
            "recommendation_to_completion_days": whole_days(F.col("recommendation_date"), F.col("completed_date")),
            "days_since_recommendation": whole_days(F.col("recommendation_date"), F.lit(as_of).cast("timestamp")),
        }
    )
    base = base.withColumns(payment_features(base, compat_max_payment))
    if similarity is None:
        base = base.withColumn("description_similarity_score", F.lit(None).cast("double"))
    else:
        base = base.join(similarity.select("project_id", "description_similarity_score"), "project_id", "left")
    deviation = peer_deviation_pct(recommended, F.col("peer_median_cost"))
    peers = with_peer_statistics(base, peers=peers).withColumn("cost_deviation_from_peer", deviation)
    return with_vendor_statistics(peers, payments).select(*FEATURE_COLUMNS)


def create_mp_features(mp_summary: DataFrame) -> DataFrame:
    allocated = F.col("allocated_amount")
    return mp_summary.select(
        *MP_COLUMNS,
        F.when(allocated != 0, F.col("total_expenditure") / allocated).alias("utilization_ratio"),
        (F.col("recommended_works") - F.col("completed_works")).alias("completion_gap"),
    )
