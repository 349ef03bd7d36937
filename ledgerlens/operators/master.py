"""Works, completions and payments to one master row per work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import normalize_description, project_key
from ledgerlens.operators.quantiles import group_quantiles, join_null_safe
from ledgerlens.operators.ranking import keep_last
from ledgerlens.schemas import MASTER_COLUMNS, MP_COLUMNS

# Statuses that count as paid and as waiting.
PAID = ["successful", "paid", "payment_completed", "completed"]
WAITING = ["pending", "in_progress", "payment_in_progress"]
NO_VENDOR, NO_PAYMENT = "Unassigned / Pending", "No Transactions"
PAYMENT_KEY = ["mp_name", "constituency", "state", "normalized_work_description"]
EXTREMES = ["average_payment", "maximum_payment", "minimum_payment"]


def exact_sum(c: str) -> Column:
    """Sum of money as decimals, so the order of addition does not matter."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def paid(status: str = "payment_status") -> Column:
    return F.count_if(F.lower(status).isin(PAID))


def waiting(status: str = "payment_status") -> Column:
    return F.count_if(F.lower(status).isin(WAITING))


def with_description_key(df: DataFrame) -> DataFrame:
    return df.withColumn("normalized_work_description", normalize_description(F.col("work_description")))


def payment_aggregate(payments: DataFrame) -> DataFrame:
    """Payments per (MP, constituency, state, normalised description); first and last by date."""
    amount, status, vendor = F.col("expenditure_amount"), F.col("payment_status"), F.col("vendor")
    total = exact_sum("expenditure_amount")
    return (
        with_description_key(payments)
        # texts with long equal beginnings sort faster behind their hash
        .groupBy(F.xxhash64(*PAYMENT_KEY).alias("__hash"), *PAYMENT_KEY)
        .agg(
            F.coalesce(total, F.lit(0.0)).alias("total_expenditure"),
            F.count("*").alias("payment_count"),
            paid().alias("successful_payment_count"),
            waiting().alias("pending_payment_count"),
            F.max_by(status, F.struct("expenditure_date", amount, status)).alias("latest_payment_status"),
            F.min_by(vendor, F.struct("expenditure_date", amount, vendor)).alias("primary_vendor"),
            (total / F.count("expenditure_amount")).alias("average_payment"),
            F.max(amount).alias("maximum_payment"),
            F.min(amount).alias("minimum_payment"),
        )
        .drop("__hash")
    )


def join_completions(works: DataFrame, completions: DataFrame) -> DataFrame:
    """Left join with the last completion record of each work id."""
    columns = ["final_amount", "completed_date", "average_rating"]
    last = keep_last(completions.select("work_id", *columns), ["work_id"], ["completed_date"])
    return works.join(last, "work_id", "left")


def join_payments(works: DataFrame, aggregate: DataFrame, unique_match_only: bool = False) -> DataFrame:
    """Every candidate work of a payment key receives the key's aggregate; works without payments get defaults.

    ``unique_match_only`` leaves keys that several works share without payments.
    """
    keyed = works if "normalized_work_description" in works.columns else with_description_key(works)
    if unique_match_only:
        shared = keyed.groupBy(*PAYMENT_KEY).agg(F.count("*").alias("__n")).filter("__n = 1").drop("__n")
        aggregate = join_null_safe(aggregate, shared, PAYMENT_KEY, "left_semi")
    joined = join_null_safe(keyed, aggregate, PAYMENT_KEY)
    zero = F.lit(0).cast("long")
    counts = ["payment_count", "successful_payment_count", "pending_payment_count"]
    return joined.withColumns(
        {c: F.coalesce(c, zero) for c in counts}
        | {
            "total_expenditure": F.coalesce("total_expenditure", F.lit(0.0)),
            "primary_vendor": F.coalesce("primary_vendor", F.lit(NO_VENDOR)),
            "latest_payment_status": F.coalesce("latest_payment_status", F.lit(NO_PAYMENT)),
        }
    )


def work_status(completed: Column, recommended: Column) -> Column:
    return F.when(completed.isNotNull(), "completed").when(recommended.isNotNull(), "in_progress").otherwise("recommended")


def spend_ratio(spent: Column, budget: Column, positive_only: bool = True) -> Column:
    """Spent over budget, null without a budget; the feature step also divides by negative budgets."""
    usable = budget > 0 if positive_only else budget != 0
    return F.when(usable, spent / budget)


def build_master_works(
    works: DataFrame, completions: DataFrame, payments: DataFrame, unique_match_only: bool = False, extremes: bool = False
) -> DataFrame:
    """The 24-column master table; ``extremes`` keeps average, maximum and minimum payment as well."""
    master = join_payments(join_completions(works, completions), payment_aggregate(payments), unique_match_only)
    # the key repeats other columns, so it is built after the joins
    key = project_key(*[F.col(c) for c in ("work_id", "mp_name", "constituency", "state")])
    ratio = spend_ratio(F.col("total_expenditure"), F.col("recommended_amount"))
    master = master.withColumns(
        {
            "project_id": key,
            "status": work_status(F.col("completed_date"), F.col("recommendation_date")),
            "financial_progress_pct": ratio * 100,
            "expenditure_ratio": ratio,
        }
    )
    return master.select(*MASTER_COLUMNS, *(EXTREMES if extremes else []))


def build_master_mp(mp_summary: DataFrame) -> DataFrame:
    return mp_summary.select(*MP_COLUMNS)


def build_vendor_features(payments: DataFrame) -> DataFrame:
    """Per vendor: distinct projects by full key, money totals and payment counts."""
    project = F.concat_ws(
        "|", normalize_description(F.col("work_description")), *[F.coalesce(c, F.lit("")) for c in PAYMENT_KEY[:3]]
    )
    total = exact_sum("expenditure_amount")
    stats = (
        payments.withColumn("__project", project)
        .groupBy("vendor")
        .agg(
            F.count_distinct("__project").alias("project_count"),
            F.coalesce(total, F.lit(0.0)).alias("total_expenditure"),
            (total / F.count("expenditure_amount")).alias("average_project_cost"),
            paid().alias("completed_project_count"),
            waiting().alias("pending_payment_count"),
            paid().alias("successful_payment_count"),
        )
    )
    medians = group_quantiles(payments, ["vendor"], "expenditure_amount", {"median_project_cost": 0.5})
    return join_null_safe(stats, medians, ["vendor"]).select(
        "vendor", "project_count", "total_expenditure", "average_project_cost", "median_project_cost",
        "completed_project_count", "pending_payment_count", "successful_payment_count",
    )


def vendor_lookup(payments: DataFrame) -> DataFrame:
    """Per vendor: distinct raw descriptions, total and mean payment."""
    total = exact_sum("expenditure_amount")
    return payments.groupBy("vendor").agg(
        F.count_distinct("work_description").alias("vendor_project_count"),
        F.coalesce(total, F.lit(0.0)).alias("vendor_total_expenditure"),
        (total / F.count("expenditure_amount")).alias("vendor_average_project_cost"),
    )


def resolve_expenditures(payments: DataFrame, works: DataFrame) -> DataFrame:
    """Payment -> work over the case-folded raw key: one distinct id resolves, several are ambiguous, none unresolved.

    Ids are counted and compared, never collected, so a key that many works share stays small.
    """
    key = {f"__{c}": F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("mp_name", "state", "constituency", "work_description")}
    ids = (
        works.select("work_id", *[k.alias(n) for n, k in key.items()])
        .filter(F.coalesce("work_id", F.lit("")) != "")
        .groupBy(*key)
        .agg(F.min("work_id").alias("__first"), F.max("work_id").alias("__last"))
    )
    single = F.col("__first") == F.col("__last")
    status = F.when(F.col("__first").isNull(), "unresolved").when(single, "resolved").otherwise("ambiguous")
    return (
        payments.withColumns(key)
        .join(ids, list(key), "left")
        .withColumns({"project_id": F.when(single, F.col("__first")), "mapping_status": status})
        .drop(*key, "__first", "__last")
    )
