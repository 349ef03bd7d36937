"""Dashboard aggregates and searches over the risk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.functions.numbers import display_score, rounded
from ledgerlens.functions.text import contains_ci
from ledgerlens.operators.fusion import join_mp_summary
from ledgerlens.operators.master import exact_sum
from ledgerlens.operators.quantiles import group_quantiles
from ledgerlens.operators.warning import prioritize_cases

TIERS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
FLAGGED = ["HIGH", "CRITICAL"]


def tier_count(tier: str) -> Column:
    return F.count_if(F.col("risk_category") == tier)


def flagged() -> Column:
    return F.count_if(F.col("risk_category").isin(FLAGGED))


def dashboard_summary(risk: DataFrame, progress: DataFrame | None = None) -> DataFrame:
    """One row of national totals; ``progress`` (financial_progress_pct) adds the mean progress."""
    totals = risk.agg(
        F.count("*").alias("total_works"),
        F.count_distinct("mp_name").alias("total_mps"),
        exact_sum("recommended_amount").alias("funds_allocated"),
        exact_sum("total_expenditure").alias("funds_utilized"),
        F.sum("is_completed").alias("completed_works"),
    )
    funds, used = F.col("funds_allocated"), F.col("funds_utilized")
    out = totals.withColumns(
        {
            "utilization_pct": F.when(funds > 0, rounded(used / funds * 100, 1)).otherwise(0.0),
            "completion_pct": F.when(
                F.col("total_works") > 0, rounded(F.col("completed_works") / F.col("total_works") * 100, 1)
            ).otherwise(0.0),
        }
    )
    if progress is None:
        return out.withColumn("avg_financial_progress", F.lit(0.0))
    mean = progress.agg(rounded(F.avg("financial_progress_pct"), 2).alias("avg_financial_progress"))
    return out.withColumn("__one", F.lit(1)).join(mean.withColumn("__one", F.lit(1)), "__one").drop("__one")


def tier_distribution(risk: DataFrame) -> DataFrame:
    """Works per tier and their share; the total comes from the four-row result."""
    counts = risk.groupBy("risk_category").agg(F.count("*").alias("works"))
    return counts.withColumn("pct", rounded(F.col("works") / F.sum("works").over(Window.partitionBy()) * 100, 2))


def top_flagged(risk: DataFrame, by: str, n: int = 10) -> DataFrame:
    """Areas or MPs with the most HIGH and CRITICAL works."""
    counts = risk.filter(F.col("risk_category").isin(FLAGGED)).groupBy(by).agg(F.count("*").alias("flagged_count"))
    return counts.orderBy(F.desc("flagged_count"), by).limit(n)


def state_risk(risk: DataFrame) -> DataFrame:
    """Tier counts, funds and flagged MPs per state."""
    is_flagged = F.col("risk_category").isin(FLAGGED)
    return risk.groupBy("state").agg(
        F.count("*").alias("total_works"),
        *[tier_count(t).alias(t.lower()) for t in TIERS],
        flagged().alias("high_critical"),
        exact_sum("recommended_amount").alias("funds_allocated"),
        exact_sum("total_expenditure").alias("funds_utilized"),
        F.count_distinct(F.when(is_flagged, F.col("mp_name"))).alias("flagged_mps"),
    )


def state_intensity(states: DataFrame) -> DataFrame:
    """4 x critical + 2 x high + medium over the worst state; the input has one row per state."""
    load = 4 * F.col("critical") + 2 * F.col("high") + F.col("medium")
    worst = F.max(load).over(Window.partitionBy())
    return states.select("state", (load / F.greatest(worst.cast("double"), F.lit(1e-9))).alias("intensity"))


def mp_table(risk: DataFrame, mp_summary: DataFrame | None = None) -> DataFrame:
    """One row per MP: place, works, flagged, scores, tiers, then the summary's columns."""
    table = risk.groupBy("mp_name").agg(
        F.min("state").alias("state"),
        F.min("constituency").alias("constituency"),
        F.count("*").alias("works"),
        flagged().alias("flagged_count"),
        F.avg("overall_risk_score").alias("avg_score"),
        F.max("overall_risk_score").alias("max_score"),
        *[tier_count(t).alias(f"{t.lower()}_count") for t in TIERS],
    )
    return table if mp_summary is None else join_mp_summary(table, mp_summary)


def signal_counts(risk: DataFrame, n: int = 20) -> DataFrame:
    """How often each engine is among the top signals."""
    part = F.explode(F.split("top_risk_signals", ";"))
    name = F.trim(F.split_part(F.col("part"), F.lit("("), F.lit(1)))
    counts = risk.select(part.alias("part")).select(name.alias("signal")).filter("signal <> ''")
    return counts.groupBy("signal").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "signal").limit(n)


def state_facets(risk: DataFrame) -> DataFrame:
    """Filter index in long form: every constituency and MP of every state, with the state's works and flagged works.

    Rows instead of lists, so a state with very many MPs does not become one huge value.
    """
    states = risk.filter("state is not null").groupBy("state").agg(F.count("*").alias("works"), flagged().alias("flagged"))
    values = F.array(
        F.struct(F.lit("constituency").alias("facet"), F.trim("constituency").alias("value")),
        F.struct(F.lit("mp").alias("facet"), F.trim("mp_name").alias("value")),
    )
    facets = risk.select("state", F.inline(values)).filter("value <> ''").distinct()
    return facets.join(states, "state")


def roster_totals(mps: DataFrame) -> DataFrame:
    return mps.agg(
        F.count("*").alias("mps"), F.sum("flagged_count").alias("flagged"), exact_sum("allocated_amount").alias("allocated")
    )


def scope_overview(risk: DataFrame, state: str | None = None, mp: str | None = None) -> DataFrame:
    """Works, completed works and tiers within a state or of an MP."""
    return search(risk, state=state, mp=mp).agg(
        F.count("*").alias("works"),
        F.coalesce(F.sum("is_completed"), F.lit(0)).alias("completed"),
        *[tier_count(t).alias(t.lower()) for t in TIERS],
    )


# --- search ---------------------------------------------------------------------------------------


def search(
    df: DataFrame, q: str | None = None, tier: str | None = None, state: str | None = None, mp: str | None = None,
    house: str | None = None, category: str | None = None, status: str | None = None, min_score: int | None = None,
    signal: str | None = None, constituency: str | None = None,
) -> DataFrame:
    """Project search: tier equality, case-insensitive literal substrings, status aliases, minimum display score."""
    keep = F.lit(True)
    if tier:
        keep &= F.col("risk_category") == tier.upper()
    substrings = {"state": state, "mp_name": mp, "house": house, "category": category, "top_risk_signals": signal, "constituency": constituency}
    for column, needle in substrings.items():
        if needle and column in df.columns:
            keep &= contains_ci(F.col(column), needle)
    if status:
        word = status.lower().strip()
        done = F.col("is_completed") == (1 if word == "completed" else 0)
        known = word in ("completed", "ongoing", "in progress", "in_progress")
        named = contains_ci(F.col("status"), word) if "status" in df.columns else F.lit(False)
        keep &= (named | done) if known or "status" not in df.columns else named
    if min_score is not None:
        keep &= F.col("overall_risk_score") >= min_score / 100
    if q:
        found = contains_ci(F.col("project_id"), q)
        if "work_description" in df.columns:
            found = found | contains_ci(F.col("work_description"), q)
        keep &= found
    return df.filter(keep)


# Named orders; nulls come last and the id breaks ties.
ORDERS = {
    "risk_desc": [("overall_risk_score", True)],
    "risk_asc": [("overall_risk_score", False)],
    "amount_desc": [("recommended_amount", True)],
    "flagged_desc": [("flagged_count", True)],
    "works_desc": [("works", True)],
    "utilization_desc": [("utilization_pct", True)],
    "completion_desc": [("completion_rate_pct", True)],
    "agency_risk_desc": [("agency_risk_score", True)],
    "agency_risk_asc": [("agency_risk_score", False)],
    "projects_desc": [("total_projects", True)],
    "upvotes_desc": [("votes", True), ("overall_risk_score", True)],
    "reports_desc": [("reports", True), ("votes", True)],
    "signals_desc": [("signals", True), ("overall_risk_score", True)],
}


def order_columns(name: str, tie: str) -> list[Column]:
    return [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in ORDERS[name]] + [F.asc(tie)]


def page_of(df: DataFrame, order: list[Column], page: int = 1, size: int = 50) -> DataFrame:
    """One page of a report in order."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(df: DataFrame, order: str, tie: str, last: tuple, size: int = 50) -> DataFrame:
    """The page after the row with sort values and tie ``last``: deep pages without counting off earlier ones."""
    columns = [*ORDERS[order], (tie, False)]
    after, equal = F.lit(False), F.lit(True)
    for (c, down), v in zip(columns, last):
        after = after | (equal & ((F.col(c) < v) if down else (F.col(c) > v)))
        equal = equal & (F.col(c) == v)
    return df.filter(after).orderBy(*order_columns(order, tie)).limit(size)


def page_info(df: DataFrame, size: int = 50) -> DataFrame:
    """Total rows and pages of a search."""
    return df.agg(F.count("*").alias("total")).withColumn(
        "pages", F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("long")
    )


def find_agency(profiles: DataFrame, agency_id: str) -> DataFrame:
    """The agency with this id, else the first whose id contains it."""
    exact = F.when(F.col("agency_id") == agency_id, 0).otherwise(1)
    found = profiles.filter((F.col("agency_id") == agency_id) | contains_ci(F.col("agency_id"), agency_id))
    return found.orderBy(exact, "agency_id").limit(1)


def compare_extremes(risk: DataFrame, n: int = 2) -> DataFrame:
    """The highest CRITICAL and the lowest LOW works side by side."""
    pick = lambda tier, order: risk.filter(F.col("risk_category") == tier).orderBy(order, "project_id").limit(n)
    return pick("CRITICAL", F.desc("overall_risk_score")).unionByName(pick("LOW", F.asc("overall_risk_score")))


def with_display(risk: DataFrame, works: DataFrame) -> DataFrame:
    """Risk rows with description, status and house of the master table."""
    shown = [c for c in ("work_description", "status", "house") if c not in risk.columns]
    return risk.join(works.select("project_id", *shown), "project_id", "left").withColumn(
        "risk_score_display", display_score(F.col("overall_risk_score"))
    )


def dossier(risk: DataFrame, master: DataFrame, features: DataFrame) -> DataFrame:
    """Investigation view: risk, master, features and priority per project; filter by id before or after."""
    from_master = [
        "work_description", "status", "final_amount", "payment_count", "successful_payment_count", "pending_payment_count",
        "latest_payment_status", "primary_vendor", "average_rating", "has_images", "ida",
    ]
    from_features = [
        "cost_variation_pct", "peer_median_cost", "peer_mean_cost", "peer_std_cost", "cost_deviation_from_peer", "average_payment",
        "maximum_payment", "minimum_payment", "payment_frequency", "days_since_recommendation",
        "recommendation_to_completion_days", "description_similarity_score",
    ]
    own = risk.drop(*[c for c in from_master + from_features if c in risk.columns])
    joined = (
        prioritize_cases(own)
        .join(master.select("project_id", *from_master), "project_id", "left")
        .join(features.select("project_id", *from_features), "project_id", "left")
    )
    return joined.withColumn("risk_score_display", display_score(F.col("overall_risk_score")))


def run_metrics(df: DataFrame, score: str, flag: str) -> DataFrame:
    """Records, flagged share, range and quantiles of a detector's score."""
    stats = df.agg(
        F.count("*").alias("total_records"), F.sum(flag).cast("long").alias("anomaly_count"), F.min(score).alias("score_min"),
        F.max(score).alias("score_max"),
    )
    spread = group_quantiles(df, [], score, {"score_median": 0.5, "score_90th": 0.9, "score_95th": 0.95})
    both = stats.withColumn("__one", F.lit(1)).join(spread.withColumn("__one", F.lit(1)), "__one").drop("__one")
    return both.withColumn("anomaly_percentage", rounded(F.col("anomaly_count") / F.col("total_records") * 100, 2))
