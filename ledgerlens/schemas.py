"""Column contracts of the tables, stated once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Raw header (canonical form) -> column, per raw table.
_PLACE = {"mp name": "mp_name", "constituency": "constituency", "state": "state", "house": "house"}
_WORK = {"work id": "work_id", "work description": "work_description", "category": "category"}
RAW_COLUMNS = {
    "recommended_works": {
        **_WORK,
        **_PLACE,
        "recommended amount": "recommended_amount",
        "recommendation date": "recommendation_date",
        "has images": "has_images",
        "ida": "ida",
    },
    "completed_works": {
        **_WORK,
        **_PLACE,
        "final amount": "final_amount",
        "completed date": "completed_date",
        "has images": "has_images",
        "average rating": "average_rating",
        "ida": "ida",
    },
    "expenditures": {
        **_PLACE,
        "work description": "work_description",
        "vendor": "vendor",
        "ida": "ida",
        "expenditure amount": "expenditure_amount",
        "expenditure date": "expenditure_date",
        "payment status": "payment_status",
    },
    "mp_summary": {
        **_PLACE,
        "allocated amount": "allocated_amount",
        "total expenditure": "total_expenditure",
        "utilization": "utilization_pct",
        "completed works": "completed_works",
        "recommended works": "recommended_works",
        "completion rate": "completion_rate_pct",
        "unspent amount": "unspent_amount",
        "transaction count": "transaction_count",
        "successful payments": "successful_payments",
        "pending payments": "pending_payments",
        "average rating": "average_rating",
    },
}
AMOUNT_COLUMNS = {
    "recommended_amount",
    "final_amount",
    "average_rating",
    "expenditure_amount",
    "allocated_amount",
    "total_expenditure",
    "utilization_pct",
    "completed_works",
    "recommended_works",
    "completion_rate_pct",
    "unspent_amount",
    "transaction_count",
    "successful_payments",
    "pending_payments",
}
DATE_COLUMNS = {"recommendation_date", "completed_date", "expenditure_date"}
BOOL_COLUMNS = {"has_images"}

MASTER_COLUMNS = [
    "project_id", "work_id", "work_description", "category", "mp_name", "constituency", "state", "house",
    "recommended_amount", "recommendation_date", "has_images", "ida", "final_amount", "completed_date",
    "average_rating", "total_expenditure", "primary_vendor", "latest_payment_status", "payment_count",
    "successful_payment_count", "pending_payment_count", "status", "financial_progress_pct", "expenditure_ratio",
]
MP_COLUMNS = [
    "mp_name", "constituency", "state", "house", "allocated_amount", "total_expenditure", "utilization_pct",
    "completed_works", "recommended_works", "completion_rate_pct", "unspent_amount", "transaction_count",
    "successful_payments", "pending_payments", "average_rating",
]
FEATURE_COLUMNS = [
    "project_id", "mp_name", "state", "constituency", "category", "recommended_amount", "final_amount",
    "total_expenditure", "cost_variation_pct", "expenditure_ratio", "payment_count", "average_payment",
    "maximum_payment", "minimum_payment", "payment_frequency", "pending_payment_count", "successful_payment_count",
    "vendor_project_count", "vendor_total_expenditure", "vendor_average_project_cost",
    "recommendation_to_completion_days", "days_since_recommendation", "is_completed", "has_images", "average_rating",
    "peer_median_cost", "peer_mean_cost", "peer_std_cost", "cost_deviation_from_peer", "description_similarity_score",
]
RISK_COLUMNS = [
    "project_id", "mp_name", "state", "constituency", "category", "recommended_amount", "total_expenditure",
    "expenditure_ratio", "is_completed", "overall_risk_score", "risk_category", "audit_explanation",
    "top_risk_signals", "risk_factors", "evidence_payload",
] + [f"{e}_{part}" for e in ("cost", "delay", "payment", "rule", "similarity", "iforest")
     for part in ("risk_score", "risk_flag", "available")]

# Dataset keys, default paths and required columns of the risk job's inputs.
DATASETS: dict[str, tuple[str, list[str]]] = {
    "base_projects": (
        "ml_input/project_features.csv",
        ["project_id", "mp_name", "state", "constituency", "category", "recommended_amount", "total_expenditure",
         "expenditure_ratio"],
    ),
    "cost_anomaly": ("ml_outputs/cost_anomaly_results.csv", ["project_id", "cost_anomaly_score", "is_cost_anomaly"]),
    "delay_predictions": (
        "ml_outputs/delay_predictions.csv",
        ["project_id", "delay_risk_score", "is_delayed_predicted", "delay_risk_level"],
    ),
    "isolation_forest": ("ml_outputs/isolation_forest_results.csv", ["project_id", "anomaly_score", "is_anomaly"]),
    "payment_anomaly": (
        "ml_outputs/payment_anomaly_results.csv",
        ["project_id", "payment_anomaly_score", "is_payment_anomaly"],
    ),
    "rule_flagged": (
        "ml_outputs/rules/flagged_projects.csv",
        ["project_id", "rule_risk_score", "risk_band", "rules_triggered", "rule_count"],
    ),
    "rule_results": (
        "ml_outputs/rules/rule_results.csv",
        ["project_id", "rule_id", "rule_name", "triggered", "severity"],
    ),
    "similarity_projects": (
        "ml_outputs/similarity/project_similarity_features.csv",
        ["project_id", "max_similarity_score", "duplicate_risk_score"],
    ),
    "similarity_pairs": (
        "ml_outputs/similarity/duplicate_project_pairs.csv",
        ["project_id_a", "project_id_b", "similarity_score"],
    ),
    "agency_profiles": ("ml_outputs/agency_profiles.csv", ["agency_id", "agency_risk_score", "agency_risk_level"]),
}
REQUIRED_DATASETS = {"base_projects"}


def require(df: DataFrame, columns: list[str], name: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks the columns {missing}")


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add the columns that are absent; columns that exist stay as they are."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})
