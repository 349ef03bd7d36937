"""Payment anomaly indicators, composite score and typology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import clip, finite, ladder, rounded, sigmoid, tags
from ledgerlens.operators.ranking import competition_rank
from ledgerlens.schemas import with_defaults

# Round-figure steps and weights.
ROUND_STEPS = [
    (1_000_000, 1.00), (500_000, 0.85), (200_000, 0.75), (100_000, 0.65),
    (50_000, 0.50), (25_000, 0.35), (10_000, 0.25), (5_000, 0.15),
]
# Input columns and what stands in for a missing column.
INPUT_DEFAULTS = {
    "total_expenditure": 0.0,
    "recommended_amount": 500_000.0,
    "payment_count": 0.0,
    "pending_payment_count": 0.0,
    "average_payment": 0.0,
    "maximum_payment": 0.0,
    "payment_frequency": 0.0,
    "peer_median_cost": 500_000.0,
}
MODEL_FEATURES = [
    "total_expenditure", "payment_count", "pending_payment_count", "round_payment_indicator",
    "payment_frequency_indicator", "budget_payment_ratio", "peer_payment_deviation",
]


def amount_roundness(amount: Column) -> Column:
    """Weight of the largest step that divides the amount; amounts with a fraction or below 5,000 get 0."""
    whole = F.rint(amount)
    steps = F.coalesce(*[F.when((whole >= m) & (whole % m == 0), F.lit(w)) for m, w in ROUND_STEPS], F.lit(0.0))
    usable = (amount > 0) & (F.abs(amount - whole) <= 0.05) & (whole >= 5000)
    return F.when(usable, steps).otherwise(F.lit(0.0))


def round_payment_indicator(total: Column, average: Column, maximum: Column) -> Column:
    r_total, r_avg, r_max = amount_roundness(total), amount_roundness(average), amount_roundness(maximum)
    blend = (
        F.when((average > 0) & (maximum > 0), 0.45 * r_avg + 0.35 * r_max + 0.20 * r_total)
        .when(maximum > 0, 0.55 * r_max + 0.45 * r_total)
        .otherwise(r_total)
    )
    return rounded(F.when(total <= 0, 0.0).otherwise(clip(blend, 0, 1)), 4)


def payment_frequency_indicator(frequency: Column, count: Column, pending: Column) -> Column:
    velocity = F.when(frequency > 0, sigmoid(frequency, 5.0, 0.25)).otherwise(0.0)
    churn = (
        F.when(count >= 20, 1.0)
        .when(count >= 10, 0.70 + (count - 10) * 0.03)
        .when(count >= 5, 0.30 + (count - 5) * 0.08)
        .when(count > 0, 0.05)
        .otherwise(0.0)
    )
    friction = ladder(pending, [(5, 0.85), (2, 0.50), (1, 0.25)], 0.0)
    peak = F.greatest(velocity, churn * 0.9, friction * 0.8)
    raised = F.when((velocity > 0.6) & (churn > 0.5), F.least(F.lit(1.0), peak + 0.15)).otherwise(peak)
    return rounded(F.when((count <= 0) & (pending <= 0), 0.0).otherwise(clip(raised, 0, 1)), 4)


def unusual_payments(total: Column, budget: Column, peer: Column) -> dict[str, Column]:
    """Budget ratio (0..1000) and deviation from the peer median in percent (-100..50000)."""
    safe_budget = F.when(budget > 0, budget).otherwise(1.0)
    safe_peer = F.when(peer > 0, peer).otherwise(500_000.0)
    ratio = clip(F.when(total > 0, total / safe_budget).otherwise(0.0), 0, 1000)
    deviation = clip(F.when(total > 0, (total - safe_peer) / safe_peer * 100).otherwise(0.0), -100, 50_000)
    return {"__ratio": ratio, "__deviation": deviation}


def magnitude_risk(total: Column, maximum: Column, ratio: Column, deviation: Column) -> Column:
    overrun = F.when(ratio > 2, 1.0).when(ratio > 1.05, 0.50 + (ratio - 1.05) * 0.40).otherwise(0.0)
    peer_risk = ladder(deviation, [(500, 0.90), (200, 0.60), (100, 0.35)], 0.0)
    large = ladder(maximum, [(5e7, 1.0), (1e7, 0.85), (5e6, 0.65), (2.5e6, 0.40)], 0.0)
    peak = clip(F.greatest(overrun, peer_risk * 0.85, large * 0.9), 0, 1)
    return rounded(F.when(total <= 0, 0.0).otherwise(peak), 4)


def payment_indicators(df: DataFrame) -> DataFrame:
    """Coerced inputs (missing columns defaulted, missing values 0) plus all indicators."""
    data = with_defaults(df, INPUT_DEFAULTS)
    data = data.withColumns({c: finite(F.col(c), 0.0) for c in INPUT_DEFAULTS})
    c = {name: F.col(name) for name in INPUT_DEFAULTS}
    data = data.withColumns(unusual_payments(c["total_expenditure"], c["recommended_amount"], c["peer_median_cost"]))
    ratio, deviation = F.col("__ratio"), F.col("__deviation")
    return data.withColumns(
        {
            "round_payment_indicator": round_payment_indicator(
                c["total_expenditure"], c["average_payment"], c["maximum_payment"]
            ),
            "payment_frequency_indicator": payment_frequency_indicator(
                c["payment_frequency"], c["payment_count"], c["pending_payment_count"]
            ),
            "magnitude_risk_score": magnitude_risk(c["total_expenditure"], c["maximum_payment"], ratio, deviation),
            "budget_payment_ratio": rounded(ratio, 4),
            "peer_payment_deviation": rounded(deviation, 2),
        }
    ).drop("__ratio", "__deviation")


def payment_composite(isolation: Column) -> Column:
    """Half peak indicator, a third isolation score, the rest round/frequency; floors for extreme cases."""
    total, ratio = F.col("total_expenditure"), F.col("budget_payment_ratio")
    round_, often = F.col("round_payment_indicator"), F.col("payment_frequency_indicator")
    count, pending = F.col("payment_count").cast("long"), F.col("pending_payment_count").cast("long")
    peak = F.greatest(F.col("magnitude_risk_score"), often * 0.9, round_ * 0.8)
    score = 0.50 * peak + 0.35 * isolation + 0.15 * F.greatest(round_, often)
    floor = F.greatest(
        F.when((ratio > 2) & (total > 0), 0.90).when((ratio > 1.20) & (total > 0), 0.70).otherwise(0.0),
        F.when((often >= 0.80) | (count >= 25), 0.85).otherwise(0.0),
        F.when(pending >= 3, 0.75).otherwise(0.0),
    )
    return F.when((total <= 0) & (pending <= 0), 0.0).otherwise(clip(F.greatest(score, floor), 0, 1))


def payment_typology() -> Column:
    total, ratio = F.col("total_expenditure"), F.col("budget_payment_ratio")
    pending, count = F.col("pending_payment_count").cast("long"), F.col("payment_count").cast("long")
    largest = F.when((F.col("maximum_payment") <= 0) & (total > 0), total).otherwise(F.col("maximum_payment"))
    found = tags(
        [
            F.when((ratio > 2) & (total > 0), "SEVERE_BUDGET_OVERRUN").when((ratio > 1.05) & (total > 0), "BUDGET_OVERRUN"),
            F.when(F.col("payment_frequency_indicator") >= 0.65, "RAPID_PAYMENT_BURST"),
            F.when(F.col("round_payment_indicator") >= 0.65, "ROUND_FIGURE_DISBURSEMENT"),
            F.when(count >= 15, "TRANSACTION_CHURN_STRUCTURING"),
            F.when(largest >= 5_000_000, "LARGE_SINGLE_PAYMENT"),
            F.when(pending >= 2, "PENDING_DISPUTE_RISK"),
        ],
        "NORMAL",
    )
    return F.when((total <= 0) & (pending <= 0), "NORMAL").otherwise(found)


def score_payments(indicators: DataFrame, isolation: str, threshold: float = 0.5) -> DataFrame:
    """Composite, flag, typology and rank, given the isolation score in column ``isolation``."""
    total, count = F.col("total_expenditure"), F.col("payment_count").cast("long")
    average, largest = F.col("average_payment"), F.col("maximum_payment")
    composite = F.col("__composite")
    vendor = [c for c in ("vendor", "vendor_name") if c in indicators.columns][:1]
    scored = indicators.withColumn("__composite", payment_composite(F.col(isolation))).select(
        "project_id",
        rounded(composite, 4).alias("payment_anomaly_score"),
        (composite >= threshold).cast("int").alias("is_payment_anomaly"),
        payment_typology().alias("payment_anomaly_type"),
        count.alias("payment_count"),
        rounded(total, 2).alias("total_payment_amount"),
        rounded(F.when((average <= 0) & (total > 0) & (count > 0), total / count).otherwise(average), 2).alias(
            "average_payment_amount"
        ),
        rounded(F.when((largest <= 0) & (total > 0), total).otherwise(largest), 2).alias("max_payment_amount"),
        "round_payment_indicator",
        "payment_frequency_indicator",
        "budget_payment_ratio",
        "peer_payment_deviation",
        *[F.coalesce(v, F.lit("Unknown")).alias(v) for v in vendor],
    )
    return competition_rank(scored, "payment_anomaly_score", "payment_anomaly_rank")
