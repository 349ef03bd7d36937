"""Data-quality reports and issue rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.numbers import rounded
from ledgerlens.functions.text import is_blank, normalize_description
from ledgerlens.operators.quantiles import group_quantiles

ERROR, ANOMALY = "DATA_QUALITY_ERROR", "POTENTIAL_ANOMALY"
# Payment statuses that the batch validation accepts.
ACCEPTED_STATUSES = [
    "successful", "pending", "paid", "payment_in_progress", "in_progress", "payment_completed", "cancelled",
    "rejected", "not_started",
]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def duplicate_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows before, exact repeats, rows after, per table."""
    reports = []
    for name, df in tables.items():
        distinct = df.groupBy(*df.columns).agg(F.count("*").alias("__copies"))
        counts = distinct.agg(
            F.coalesce(F.sum("__copies"), F.lit(0)).alias("rows_before"), F.count("*").alias("rows_after")
        )
        reports.append(
            counts.select(
                F.lit(name).alias("dataset"),
                "rows_before",
                (F.col("rows_before") - F.col("rows_after")).alias("exact_duplicates"),
                "rows_after",
            )
        )
    return union_all(reports)


def melt(row: DataFrame, values: dict[str, Column], name: str, value: str) -> DataFrame:
    """A one-row frame as (name, value) rows."""
    entries = F.array(*[F.struct(F.lit(k).alias(name), v.alias(value)) for k, v in values.items()])
    return row.select(F.inline(entries))


def missing_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns with nulls, per table: count and percentage."""
    reports = []
    for name, df in tables.items():
        counts = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing_count")) for c in df.columns])
        reports.append(
            counts.select("__n", F.inline(entries))
            .filter("missing_count > 0")
            .select(
                F.lit(name).alias("dataset"),
                "column_name",
                "missing_count",
                rounded(F.col("missing_count") / F.col("__n") * 100, 2).alias("missing_percentage"),
            )
        )
    return union_all(reports)


# --- issue rows -----------------------------------------------------------------------------------


def issue(kind: str, category: str, field: str, message: str, when: Column) -> Column:
    """One nullable issue; ``issues`` turns a list of them into rows in a single scan."""
    row = F.struct(
        F.lit(kind).alias("issue_type"),
        F.lit(category).alias("issue_category"),
        F.lit(field).alias("field"),
        F.lit(message).alias("message"),
    )
    return F.when(F.coalesce(when, F.lit(False)), row)


def issues(df: DataFrame, dataset: str, row_id: str, checks: list[Column]) -> DataFrame:
    found = df.select(F.col(row_id).cast("string").alias("row_id"), F.explode(F.array_compact(F.array(*checks))).alias("i"))
    return found.select(F.lit(dataset).alias("dataset"), "i.issue_type", "i.issue_category", "i.field", "row_id", "i.message")


def missing_key_checks(key: str) -> list[Column]:
    return [issue(f"missing_{key}", ERROR, key, f"{key} is missing", is_blank(F.col(key)))]


def amount_checks(columns: list[str], zero: bool = True) -> list[Column]:
    """Negative amounts, and zero ones (null counts as zero)."""
    out = []
    for c in columns:
        out.append(issue("negative_amount", ANOMALY, c, f"{c} is negative", F.col(c) < 0))
        if zero:
            out.append(issue("zero_amount", ANOMALY, c, f"{c} is zero", F.coalesce(F.col(c), F.lit(0.0)) == 0))
    return out


def status_checks(column: str, accepted: list[str] = ACCEPTED_STATUSES) -> list[Column]:
    bad = ~F.coalesce(F.lower(column).isin(accepted), F.lit(False))
    return [issue("invalid_payment_status", ERROR, column, "Payment status is not in the accepted set", bad)]


def required_checks(columns: list[str]) -> list[Column]:
    return [issue(f"missing_{c}", ERROR, c, f"{c} is missing", is_blank(F.col(c))) for c in columns]


def percentage_checks(columns: list[str]) -> list[Column]:
    return [
        issue("invalid_percentage", ERROR, c, f"{c} is out of range", (F.col(c) < 0) | (F.col(c) > 100)) for c in columns
    ]


def duplicate_key_issues(df: DataFrame, dataset: str, key: str, row_id: str) -> DataFrame:
    """Every row whose non-blank key occurs more than once, reported once.

    Keys are counted with map-side combining and only repeated keys are joined back, so one key that
    holds much of the table is never gathered in a single task.
    """
    rows = df.select(F.trim(F.col(key).cast("string")).alias("__k"), F.col(row_id).cast("string").alias("row_id"))
    rows = rows.filter(F.col("__k") != "")
    repeated = rows.groupBy("__k").agg(F.count("*").alias("__n")).filter("__n > 1").select("__k")
    return rows.join(repeated, "__k", "left_semi").select(
        F.lit(dataset).alias("dataset"),
        F.lit(f"duplicate_{key}").alias("issue_type"),
        F.lit(ERROR).alias("issue_category"),
        F.lit(key).alias("field"),
        "row_id",
        F.lit(f"Duplicate {key} detected").alias("message"),
    )


def issue_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("issue_category").agg(F.count("*").alias("issues"))


# --- matching and reconciliation ------------------------------------------------------------------

MATCH_KEY = ["mp_name", "constituency", "state", "__description"]


def with_match_key(df: DataFrame) -> DataFrame:
    """Trimmed place columns and the normalised description, nulls as blanks."""
    key = {f"__{c}": F.trim(F.coalesce(c, F.lit(""))) for c in ("mp_name", "constituency", "state")}
    return df.withColumns(key | {"__description": normalize_description(F.col("work_description"))})


def expenditure_matching(payments: DataFrame, works: DataFrame) -> DataFrame:
    """Candidate works per payment over the four-column key: matched, ambiguous or unmatched."""
    key = ["__mp_name", "__constituency", "__state", "__description"]
    candidates = with_match_key(works).groupBy(*key).agg(F.count("*").alias("__c"))
    count = F.coalesce("__c", F.lit(0).cast("long"))
    status = F.when(count == 1, "matched").when(count > 1, "ambiguous").otherwise("unmatched")
    return (
        with_match_key(payments)
        .join(candidates, key, "left")
        .select("mp_name", "constituency", "state", "work_description", status.alias("match_status"), count.alias("candidate_count"))
    )


def allocation_reconciliation(mp_summary: DataFrame, allocations: DataFrame) -> DataFrame:
    """Allocated amounts of the summary against a second source, by MP (``allocations``: mp_name, allocation)."""
    other = allocations.select("mp_name", F.col("allocation").alias("allocation_from_excel"))
    summary = mp_summary.select("mp_name", "constituency", "state", F.col("allocated_amount").alias("allocation_from_mp_summary"))
    difference = F.col("allocation_from_excel") - F.col("allocation_from_mp_summary")
    status = (
        F.when(difference.isNotNull(), F.when(F.abs(difference) <= 1e-6, "match").otherwise("difference"))
        .when(F.col("allocation_from_excel").isNotNull(), "missing_in_summary")
        .otherwise("missing_in_excel")
    )
    return summary.join(other, "mp_name", "left").withColumns({"difference": difference, "reconciliation_status": status})


# --- column and key reports -----------------------------------------------------------------------


def feature_quality_report(df: DataFrame) -> DataFrame:
    """Per column: type, nulls, distinct values, min, max, mean, median and whether a model can use it.

    Columns become (feature, value) rows that are first counted per distinct value, so the shuffle
    spreads over values and one wide column does not land in one task.
    """
    numeric = {f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))}
    as_number = lambda c: F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
    cells = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f.name).alias("feature_name"),
                        F.lit(f.dataType.simpleString()).alias("dtype"),
                        F.lit(f.name in numeric).alias("__numeric"),
                        F.col(f.name).cast("string").alias("__text"),
                        as_number(f.name).alias("__number"),
                    )
                    for f in df.schema
                ]
            )
        )
    )
    by = ["feature_name", "dtype", "__numeric"]
    values = cells.groupBy(*by, "__text", "__number").agg(F.count("*").alias("__c"))
    present = F.col("__text").isNotNull()
    stats = values.groupBy(*by).agg(
        F.sum("__c").alias("__n"),
        F.coalesce(F.sum(F.when(~present, F.col("__c"))), F.lit(0)).alias("missing_count"),
        F.count_if(present).alias("unique_values"),
        F.min("__number").alias("min"),
        F.max("__number").alias("max"),
        (F.sum(F.col("__number") * F.col("__c")) / F.sum(F.when(F.col("__number").isNotNull(), F.col("__c")))).alias("mean"),
    )
    medians = group_quantiles(cells.filter("__number is not null"), ["feature_name"], "__number", {"median": 0.5})
    usable = F.col("__numeric") & (F.col("missing_count") < F.greatest(F.lit(1), F.floor(F.col("__n") * 0.5)))
    return stats.join(medians, "feature_name", "left").select(
        "feature_name",
        "dtype",
        "missing_count",
        rounded(F.col("missing_count") / F.col("__n") * 100, 2).alias("missing_percentage"),
        "unique_values",
        "min",
        "max",
        "mean",
        "median",
        usable.alias("usable_for_ml"),
        F.when(usable, "Numeric feature usable for ML.")
        .otherwise("Categorical or highly sparse; use with caution.")
        .alias("notes"),
    )


def key_report(df: DataFrame, dataset: str, key: str) -> DataFrame:
    """Nulls, distinct keys and repeats of a primary key."""
    counted = df.groupBy(key).agg(F.count("*").alias("__c"))
    return counted.agg(
        F.coalesce(F.sum("__c"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("__c"))), F.lit(0)).alias("null_count"),
        F.count_if(F.col(key).isNotNull()).alias("unique_keys"),
    ).select(
        F.lit(dataset).alias("dataset"),
        F.lit(key).alias("key_col"),
        "total_rows",
        "null_count",
        "unique_keys",
        (F.col("total_rows") - F.col("unique_keys")).alias("duplicate_count"),
        ((F.col("null_count") == 0) & (F.col("total_rows") == F.col("unique_keys"))).alias("is_valid"),
    )


def score_bounds(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Observed range of each score column against its bounds, with a tolerance of 1e-4."""
    value = lambda c: F.when(~F.isnan(F.col(c)), F.col(c).cast("double"))
    stats = df.agg(
        *[f(value(c)).alias(f"{c}__{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max")) for c in columns]
    )
    infinite = F.greatest(F.abs("min"), F.abs("max")) == float("inf")
    inside = (F.col("min") >= low - 1e-4) & (F.col("max") <= high + 1e-4)
    return stats.select(F.inline(rows)).withColumns(
        {"has_inf": F.coalesce(infinite, F.lit(False)), "is_valid": F.coalesce(inside & ~infinite, F.lit(True))}
    )


def merge_cardinality(base: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """Does a join keep one row per key of the base?"""
    before = base.agg(F.count("*").alias("base_rows"))
    after = (
        merged.groupBy(key)
        .agg(F.count("*").alias("__c"))
        .agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("merged_rows"), F.count_if(F.col(key).isNotNull()).alias("merged_keys"))
    )
    both = before.select(F.lit(1).alias("__one"), "base_rows").join(after.withColumn("__one", F.lit(1)), "__one")
    return both.select(
        "base_rows",
        "merged_rows",
        "merged_keys",
        ((F.col("base_rows") == F.col("merged_rows")) & (F.col("merged_rows") == F.col("merged_keys"))).alias("preserved"),
    )
