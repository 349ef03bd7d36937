"""Vendor (agency) profiles with small-sample shrinkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import clip, finite, fixed, ladder, rounded, tags
from ledgerlens.operators.quantiles import group_quantiles, join_null_safe
from ledgerlens.session import materialize

# Weights of delay, incompletion, finance, payment friction and anomalies.
WEIGHTS = (0.28, 0.24, 0.20, 0.16, 0.12)


def _number(df: DataFrame, name: str, default: float) -> Column:
    return finite(F.col(name), default) if name in df.columns else F.lit(float(default))


def _skew(mean: Column, median: Column) -> Column:
    base = F.when(median > 0, median).when(mean > 0, mean).otherwise(1.0)
    return F.when(mean > 0, mean / base).otherwise(1.0)


def vendor_performance(df: DataFrame, agency: str = "vendor") -> DataFrame:
    """Standard performance columns from a table with one row per vendor."""
    whole = lambda name, default: _number(df, name, default).cast("long")
    zero = F.lit(0).cast("long")
    total = F.greatest(F.lit(1).cast("long"), whole("project_count", 1))
    completed = F.least(F.greatest(whole("completed_project_count", 0), zero), total)
    mean, median = _number(df, "average_project_cost", 0), _number(df, "median_project_cost", 0)
    pending = F.greatest(zero, whole("pending_payment_count", 0))
    name = F.col(agency).cast("string")
    return df.select(
        (F.col("agency_id").cast("string") if "agency_id" in df.columns else name).alias("agency_id"),
        name.alias("agency_name"),
        total.alias("total_projects"),
        completed.alias("completed_projects"),
        (total - completed).alias("ongoing_projects"),
        rounded(completed / total * 100, 2).alias("completion_rate"),
        rounded(F.greatest(F.lit(0.0), _number(df, "total_expenditure", 0)), 2).alias("total_expenditure"),
        rounded(mean, 2).alias("average_project_cost"),
        rounded(median, 2).alias("median_project_cost"),
        rounded(_number(df, "average_utilization", 100), 2).alias("average_utilization"),
        pending.alias("pending_payment_count"),
        rounded(pending / total, 4).alias("pending_payment_rate"),
        rounded(clip(_skew(mean, median), 0.1, 50), 2).alias("cost_skewness"),
        whole("anomaly_count", 0).alias("anomaly_count"),
        whole("high_risk_project_count", 0).alias("high_risk_project_count"),
    )


def project_performance(df: DataFrame, agency: str) -> DataFrame:
    """The same columns, and the delay history, aggregated from project rows."""
    spent = _number(df, "total_expenditure", 0)
    budget = _number(df, "recommended_amount", 0)
    first = lambda names: next((n for n in names if n in df.columns), None)
    anomaly = first(["is_anomaly", "is_cost_anomaly", "is_payment_anomaly", "anomaly"])
    risky = first(["is_delayed", "is_high_risk", "high_risk"])
    late = first(["is_delayed", "is_delayed_predicted"])
    count = lambda name: F.sum(finite(F.col(name), 0)).cast("long") if name else F.lit(0).cast("long")
    use = F.when(spent > 0, spent / F.when(budget > 0, budget).otherwise(1.0) * 100).otherwise(100.0)
    days = finite(F.col("delay_days"), 0) if "delay_days" in df.columns else None
    used = {agency, "agency_id", "agency_name", "recommended_amount", "total_expenditure", "is_completed", "pending_payment_count", "delay_days", anomaly, risky, late}
    # read for the sums, the sketch and the band of the medians
    rows = materialize(df.filter(F.col(agency).isNotNull()).select(*[c for c in df.columns if c in used], spent.alias("__spent")), "projects")
    label = lambda name: F.min(name) if name in df.columns else F.first(F.col(agency))
    stats = rows.groupBy(F.col(agency).alias("__agency")).agg(
        label("agency_id").cast("string").alias("agency_id"),
        label("agency_name").cast("string").alias("agency_name"),
        F.count("*").alias("total_projects"),
        count("is_completed" if "is_completed" in df.columns else None).alias("__completed"),
        F.sum(spent.cast("decimal(18,2)")).cast("double").alias("__total"),
        F.avg(use).alias("__use"),
        count("pending_payment_count" if "pending_payment_count" in df.columns else None).alias("pending_payment_count"),
        count(anomaly).alias("anomaly_count"),
        count(risky or anomaly).alias("high_risk_project_count"),
        (F.count_if(finite(F.col(late), 0) > 0) if late else F.lit(0).cast("long")).alias("__late"),
        (F.avg(F.when(days > 0, days)) if days is not None else F.lit(None).cast("double")).alias("__late_days"),
    )
    medians = group_quantiles(rows.withColumnRenamed(agency, "__agency"), ["__agency"], "__spent", {"__median": 0.5})
    total, completed = F.col("total_projects"), F.least(F.col("__completed"), F.col("total_projects"))
    mean = F.col("__total") / total
    rate = F.col("__late") / total * 100
    lateness = F.coalesce("__late_days", F.lit(0.0)) if days is not None else rate * 3.65
    risk = clip(rate * 0.70 + F.least(F.lit(100.0), lateness / 180 * 30), 0, 100)
    return join_null_safe(stats, medians, ["__agency"]).select(
        "agency_id",
        "agency_name",
        "total_projects",
        completed.alias("completed_projects"),
        (total - completed).alias("ongoing_projects"),
        rounded(completed / total * 100, 2).alias("completion_rate"),
        rounded(F.col("__total"), 2).alias("total_expenditure"),
        rounded(mean, 2).alias("average_project_cost"),
        rounded(F.col("__median"), 2).alias("median_project_cost"),
        rounded(F.col("__use"), 2).alias("average_utilization"),
        "pending_payment_count",
        rounded(F.col("pending_payment_count") / total, 4).alias("pending_payment_rate"),
        rounded(_skew(mean, F.col("__median")), 2).alias("cost_skewness"),
        "anomaly_count",
        "high_risk_project_count",
        rounded(rate, 2).alias("delay_rate"),
        rounded(lateness, 1).alias("average_delay_days"),
        rounded(risk, 2).alias("delay_risk"),
    )


def vendor_delay_history(performance: DataFrame) -> DataFrame:
    """Delay columns for vendor tables, which only show pending payments."""
    total, pending = F.col("total_projects"), F.col("pending_payment_count")
    rate = pending / total
    incomplete = F.when(total >= 3, 100 - F.col("completion_rate")).otherwise(20.0)
    friction = F.least(F.lit(100.0), rate * 80 + pending * 5.0)
    return performance.withColumns(
        {
            "delay_rate": rounded(clip(rate * 100, 0, 100), 2),
            "average_delay_days": rounded(rate * 90, 1),
            "delay_risk": rounded(clip(0.60 * friction + 0.40 * incomplete, 0, 100), 2),
        }
    )


def risk_level(score: Column) -> Column:
    return ladder(score, [(75, "CRITICAL"), (55, "HIGH"), (30, "MEDIUM")], "LOW")


def agency_score(k: float = 3.0, baseline: float = 15.0) -> Column:
    """Weighted components, shrunk towards ``baseline`` for agencies with few projects."""
    n, pending, skew, use = (
        F.col(c) for c in ("total_projects", "pending_payment_count", "cost_skewness", "average_utilization")
    )
    hundred, zero = F.lit(100.0), F.lit(0.0)
    incomplete = F.when(n >= 2, F.greatest(zero, 100 - F.col("completion_rate"))).otherwise(20.0)
    finance = F.greatest(
        F.least(hundred, F.greatest(zero, (skew - 1) * 35)),
        F.when(use > 105, F.least(hundred, F.greatest(zero, (use - 100) * 1.5))).otherwise(zero),
    )
    friction = F.least(hundred, F.col("pending_payment_rate") * 75 + pending * 6.0)
    anomalies = F.least(hundred, F.col("anomaly_count") / n * 60 + F.col("high_risk_project_count") / n * 40)
    parts = (F.col("delay_risk"), incomplete, finance, friction, anomalies)
    raw = sum((F.lit(w) * c for w, c in zip(WEIGHTS, parts)), zero)
    weight = n / (n + k)
    return clip(weight * raw + (1 - weight) * baseline, 0, 100)


def agency_reasons(level: Column) -> Column:
    n, rate, days, use = (F.col(c) for c in ("total_projects", "delay_rate", "average_delay_days", "average_utilization"))
    pending, skew, done = F.col("pending_payment_count"), F.col("cost_skewness"), F.col("completion_rate")
    reasons = tags(
        [
            F.when(n < 3, "Low historical volume (score credibility shrunk toward baseline)"),
            F.when(rate >= 40, F.concat(F.lit("High historical delay rate ("), fixed(rate, 1), F.lit("%)"))).when(
                days >= 60, F.concat(F.lit("Significant average project delay ("), fixed(days, 0), F.lit(" days)"))
            ),
            F.when(
                (done < 20) & (n >= 3), F.concat(F.lit("Low project completion rate ("), fixed(done, 1), F.lit("%)"))
            ),
            F.when(
                pending >= 2,
                F.concat(F.lit("High pending payment friction ("), pending.cast("string"), F.lit(" pending payments)")),
            ),
            F.when(
                (skew >= 1.5) & (n >= 2),
                F.concat(F.lit("Significant cost skewness (mean project cost "), fixed(skew, 1), F.lit("x median)")),
            ),
            F.when(
                F.col("anomaly_count") > 0,
                F.concat(
                    F.lit("Historical cost/project anomalies recorded ("), F.col("anomaly_count").cast("string"), F.lit(" projects)")
                ),
            ),
            F.when(
                use > 120, F.concat(F.lit("Average expenditure exceeds sanctioned budget ("), fixed(use, 1), F.lit("%)"))
            ),
        ],
        sep="; ",
    )
    calm = F.when(level == "LOW", "Consistent on-time project execution with low operational friction").otherwise(
        "Moderate overall operational and financial performance"
    )
    return F.when(reasons == "", calm).otherwise(reasons)


PROFILE = [
    "agency_id", "agency_name", "total_projects", "completed_projects", "ongoing_projects", "completion_rate",
    "delay_rate", "average_delay_days", "average_utilization", "anomaly_count", "high_risk_project_count",
    "agency_risk_score", "agency_risk_level", "risk_level", "risk_reasons",
]


def profile(performance: DataFrame, k: float = 3.0, baseline: float = 15.0) -> DataFrame:
    """Scores, levels and reasons on performance rows that carry their delay columns."""
    scored = performance.withColumn("__score", agency_score(k, baseline))
    level = risk_level(F.col("__score"))
    return scored.withColumns(
        {
            "agency_risk_score": rounded(F.col("__score"), 2),
            "agency_risk_level": level,
            "risk_level": level,
            "risk_reasons": agency_reasons(level),
        }
    ).select(*PROFILE)


def profile_vendors(vendors: DataFrame, agency: str = "vendor", **shrink) -> DataFrame:
    """Profiles from a table with one row per vendor."""
    return profile(vendor_delay_history(vendor_performance(vendors, agency)), **shrink)


def profile_projects(projects: DataFrame, agency: str, **shrink) -> DataFrame:
    """Profiles from project rows; the caller chooses between this and ``profile_vendors``."""
    return profile(project_performance(projects, agency), **shrink)


def with_vendor_risk(risk: DataFrame, master: DataFrame, profiles: DataFrame) -> DataFrame:
    """Risk rows with the score and level of the project's primary vendor."""
    scores = profiles.select(
        F.col("agency_id").alias("__vendor"),
        F.col("agency_risk_score").alias("vendor_risk_score"),
        F.col("agency_risk_level").alias("vendor_risk_level"),
    )
    vendor = master.select("project_id", F.nullif(F.trim("primary_vendor"), F.lit("")).alias("__vendor"))
    return risk.join(vendor, "project_id", "left").join(scores, "__vendor", "left").drop("__vendor")
