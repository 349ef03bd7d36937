"""Spend trends, early-warning alerts, case priority and reason texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import clip, finite, fixed, money, rounded
from ledgerlens.operators.quantiles import group_quantiles, join_null_safe
from ledgerlens.operators.ranking import sequence_rank, top_rows


def analyze_trends(df: DataFrame) -> DataFrame:
    """Daily spend, its peer median by category and state, and the burn status."""
    days = F.greatest(finite(F.col("days_since_recommendation"), 0), F.lit(1.0))
    spent, budget = finite(F.col("total_expenditure"), 0), finite(F.col("recommended_amount"), 0)
    base = df.select(
        "project_id",
        days.alias("days_since_recommendation"),
        rounded(spent / days, 2).alias("spend_velocity_daily"),
        F.coalesce("category", F.lit("Other")).alias("__category"),
        F.coalesce("state", F.lit("Other")).alias("__state"),
        (F.coalesce(F.col("is_completed").cast("int"), F.lit(0)) == 1).alias("__done"),
        spent.alias("__spent"),
        F.when(budget > 0, spent / budget).otherwise(0.0).alias("__use"),
    )
    keys = ["__category", "__state"]
    peers = group_quantiles(base, keys, "spend_velocity_daily", {"__median": 0.5})
    velocity, gone, done = F.col("spend_velocity_daily"), F.col("days_since_recommendation"), F.col("__done")
    joined = join_null_safe(base, peers, keys).withColumn(
        "peer_median_velocity", rounded(F.coalesce("__median", F.lit(100.0)), 2)
    )
    peer = F.col("peer_median_velocity")
    joined = joined.withColumn(
        "velocity_ratio_vs_peer", F.when(peer > 0, rounded(velocity / peer, 2)).otherwise(1.0)
    )
    ratio = F.col("velocity_ratio_vs_peer")
    runaway = (ratio >= 2.5) & ~done & (F.col("__spent") > 50_000)
    stalled = (gone >= 365) & (F.col("__use") < 0.10) & ~done
    status = (
        F.when(runaway, "RUNAWAY_BURN")
        .when(stalled, "STALLED_DECAY")
        .when(ratio >= 1.5, "ACCELERATED")
        .when(gone < 90, "NEW_PROJECT")
        .otherwise("NORMAL")
    )
    return joined.select(
        "project_id", "days_since_recommendation", "spend_velocity_daily", "peer_median_velocity",
        "velocity_ratio_vs_peer", runaway.alias("is_runaway_spend"), stalled.alias("is_stalled_decay"),
        status.alias("burn_rate_status"),
    )


def _alert(code: str, severity: str, title: str, detail: Column, action: str, when: Column) -> Column:
    row = F.struct(
        F.lit(code).alias("alert_code"),
        F.lit(severity).alias("alert_severity"),
        F.lit(title).alias("alert_title"),
        detail.alias("alert_detail"),
        F.lit(action).alias("recommended_action"),
    )
    return F.when(F.coalesce(when, F.lit(False)), row)


def _value(df: DataFrame, name: str) -> Column:
    return finite(F.col(name), 0) if name in df.columns else F.lit(0.0)


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in df.columns else F.lit(False)


def budget_overrun(df: DataFrame) -> Column:
    ratio, spent, budget = (_value(df, c) for c in ("expenditure_ratio", "total_expenditure", "recommended_amount"))
    detail = F.concat(
        F.lit("Expenditure exceeds sanctioned amount by "), fixed((ratio - 1) * 100, 1), F.lit("% (Spent: ₹"), money(spent, 0),
        F.lit(" vs Sanctioned: ₹"), money(budget, 0), F.lit(")"),
    )
    return _alert(
        "WARN_BUDGET_OVERRUN", "CRITICAL", "Severe Budget Overrun Triggered", detail,
        "Freeze disbursements and audit revised administrative sanction.", (ratio > 1.10) & (spent > 100_000),
    )


def runaway_velocity(df: DataFrame) -> Column:
    velocity, peer = _value(df, "spend_velocity_daily"), _value(df, "peer_median_velocity")
    fires = _flag(df, "is_runaway_spend")
    if "burn_rate_status" in df.columns:
        fires = fires | (F.col("burn_rate_status") == "RUNAWAY_BURN")
    detail = F.concat(
        F.lit("Project is burning funds at ₹"), fixed(velocity, 0), F.lit("/day ("),
        fixed(velocity / F.greatest(peer, F.lit(1.0)), 1), F.lit("x peer median rate) while incomplete."),
    )
    return _alert(
        "WARN_RUNAWAY_VELOCITY", "WARNING", "Abnormal Expenditure Velocity", detail,
        "Conduct immediate physical site milestone verification.", fires,
    )


def chronic_stall(df: DataFrame) -> Column:
    days, ratio = _value(df, "days_since_recommendation"), _value(df, "expenditure_ratio")
    detail = F.concat(
        F.lit("Work has remained dormant for "), days.cast("long").cast("string"),
        F.lit(" days since recommendation with <10% utilization."),
    )
    return _alert(
        "WARN_CHRONIC_STALL", "WARNING", "Chronic Project Inactivity", detail,
        "Issue inquiry to nodal district authority on implementation hurdles.",
        (days >= 365) & (ratio < 0.10) & (_value(df, "is_completed") != 1),
    )


def impending_delay(df: DataFrame) -> Column:
    days = _value(df, "predicted_completion_days")
    detail = F.concat(
        F.lit("ML model forecasts completion will require ~"), days.cast("long").cast("string"),
        F.lit(" days based on agency friction and history."),
    )
    return _alert(
        "WARN_IMPENDING_DELAY", "ADVISORY", "Predicted Prolonged Execution Duration", detail,
        "Review contractor capacity and establish monthly progress checkpoints.",
        (days >= 500) & (_value(df, "is_completed") != 1),
    )


def payment_churn(df: DataFrame) -> Column:
    return _alert(
        "WARN_PAYMENT_CHURN", "CRITICAL", "High-Frequency Payment Churn Detected",
        F.lit("Unusual burst or round-sum payment pattern flagged by payment anomaly detector."),
        "Inspect bank transaction timestamps and contractor vendor vouchers.",
        _flag(df, "payment_risk_flag") | (_value(df, "payment_risk_score") >= 0.70),
    )


ALERTS = [budget_overrun, runaway_velocity, chronic_stall, impending_delay, payment_churn]


def generate_alerts(projects: DataFrame, trends: DataFrame | None = None, alerts: list = ALERTS) -> DataFrame:
    """Zero to five alert rows per project; where both sides have a column, the trend side wins."""
    df = projects
    if trends is not None:
        shared = [c for c in trends.columns if c in df.columns and c != "project_id"]
        df = df.drop(*shared).join(trends, "project_id", "left")
    found = F.array_compact(F.array(*[a(df) for a in alerts]))
    place = [F.coalesce(c, F.lit("N/A")).alias(c) if c in df.columns else F.lit("N/A").alias(c) for c in ("mp_name", "state")]
    return df.select("project_id", *place, F.inline(found))


# --- investigation --------------------------------------------------------------------------------


def prioritize_cases(df: DataFrame) -> DataFrame:
    """Priority 0..100 from risk (60 %) and logarithmic exposure (40 %), urgency tier and dispatch flag."""
    risk, spent = finite(F.col("overall_risk_score"), 0), finite(F.col("total_expenditure"), 0)
    exposure = clip((F.log10(clip(spent, 1e4, 5e7)) - 4.0) / 3.7, 0, 1)
    raw = (risk * 0.60 + exposure * 0.40) * 100
    urgency = (
        F.when((risk >= 0.70) | (raw >= 65), "TIER_1_IMMEDIATE_ACTION")
        .when((risk >= 0.45) | (raw >= 45), "TIER_2_PRIORITY_INSPECTION")
        .when((risk >= 0.25) | (raw >= 30), "TIER_3_DESK_REVIEW")
        .otherwise("TIER_4_ROUTINE")
    )
    return df.withColumns(
        {
            "investigation_priority_score": rounded(raw, 2),
            "investigation_urgency": urgency,
            "audit_dispatch_recommended": urgency == "TIER_1_IMMEDIATE_ACTION",
        }
    )


def rank_cases(df: DataFrame, top_n: int | None = None) -> DataFrame:
    """Prioritised cases numbered by score, then id; all of them, or the first ``top_n``."""
    order = [F.desc("investigation_priority_score"), F.asc("project_id")]
    scored = prioritize_cases(df)
    if top_n is None:
        return sequence_rank(scored, order, "investigation_rank")
    return top_rows(scored, order, top_n, "investigation_rank")
