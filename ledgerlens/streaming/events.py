"""Event derivation, validation, routing and folds.

Everything here is built from column expressions and aggregates, so it runs on a table and on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import iso_utc
from ledgerlens.functions.numbers import any_of
from ledgerlens.functions.text import event_id, fingerprint, stream_payment_status
from ledgerlens.operators.master import WAITING, resolve_expenditures
from ledgerlens.operators.quality import union_all

# Event vocabulary.
EVENT_TYPES = [
    "PROJECT_CREATED", "PROJECT_RECOMMENDED", "PAYMENT_RECEIVED", "PAYMENT_STATUS_UPDATED", "PROJECT_STATUS_UPDATED",
    "PROJECT_COMPLETED",
]
EVENT_SOURCES = ["historical_replay", "synthetic_demo", "manual"]
PAYMENT_STATUSES = [
    "successful", "pending", "in_progress", "payment_in_progress", "paid", "payment_completed", "cancelled", "completed",
    "no_transactions",
]
REQUIRED = ["event_id", "event_type", "event_timestamp", "event_source", "project_id", "mp_name", "state", "constituency"]
AMOUNTS = ["recommended_amount", "final_amount", "expenditure_amount"]


def derive_events(master: DataFrame, payments: DataFrame) -> DataFrame:
    """Recommended and completed events of works with those dates, and two events per dated payment.

    Payments are mapped to works by their exact key; unmapped ones keep a placeholder id and their status.
    """
    work = fingerprint({c: F.col(c) for c in master.columns})
    source = F.lit("historical_replay").alias("event_source")
    place = ["mp_name", "state", "constituency", "work_description"]

    def of_work(kind: str, day: str, amount: str, status: Column) -> DataFrame:
        return master.filter(F.col(day).isNotNull()).select(
            event_id("hist", F.col("work_id"), F.lit(kind), work).alias("event_id"), F.lit(kind).alias("event_type"),
            iso_utc(F.col(day)).alias("event_timestamp"), source, F.col("work_id").alias("project_id"), *place, "category",
            F.col(amount).alias(amount), status.alias("project_status"),
            *([iso_utc(F.col(day)).alias("completed_date")] if kind == "PROJECT_COMPLETED" else []),
        )

    mapped = resolve_expenditures(payments, master).filter(F.col("expenditure_date").isNotNull())
    mapped = mapped.withColumn("__fp", fingerprint({c: F.col(c) for c in payments.columns}))
    key = F.coalesce("project_id", F.concat(F.lit("unresolved-"), F.col("__fp")))
    status = F.coalesce(stream_payment_status(F.col("payment_status")), F.lit("unknown"))

    def of_payment(kind: str, extra: list) -> DataFrame:
        return mapped.select(
            event_id("hist", key, F.lit(kind), F.col("__fp")).alias("event_id"), F.lit(kind).alias("event_type"),
            iso_utc(F.col("expenditure_date")).alias("event_timestamp"), source, key.alias("project_id"), "mapping_status", *place,
            status.alias("payment_status"), F.trim("payment_status").alias("payment_status_raw"),
            iso_utc(F.col("expenditure_date")).alias("payment_date"), status.alias("project_status"), *extra,
        )

    kinds = [
        of_work("PROJECT_RECOMMENDED", "recommendation_date", "recommended_amount", F.coalesce("status", F.lit("in_progress"))),
        of_work("PROJECT_COMPLETED", "completed_date", "final_amount", F.lit("completed")),
        of_payment("PAYMENT_RECEIVED", ["expenditure_amount", F.trim("vendor").alias("vendor")]),
        of_payment("PAYMENT_STATUS_UPDATED", []),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k, allowMissingColumns=True)
    return out


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def invalid_reason(df: DataFrame) -> Column:
    """First failed check of an event, null when it is valid."""
    blank = lambda c: F.coalesce(_column(df, c).cast("string"), F.lit("")) == ""
    undated = lambda c: ~blank(c) & _column(df, c).try_cast("timestamp").isNull()
    status = stream_payment_status(_column(df, "payment_status"))
    amounts = [c for c in AMOUNTS if c in df.columns]
    bad = [F.col(c).isNotNull() & (F.coalesce(F.col(c).try_cast("double"), F.lit(-1.0)) < 0) for c in amounts]
    return (
        F.when(any_of([blank(c) for c in REQUIRED]), "missing required field")
        .when(~F.upper("event_type").isin(EVENT_TYPES), "unknown event type")
        .when(~F.col("event_source").isin(EVENT_SOURCES), "unknown event source")
        .when(undated("event_timestamp"), "invalid event timestamp")
        .when(any_of(bad) if bad else F.lit(False), "invalid amount")
        .when(status.isNotNull() & ~status.isin(PAYMENT_STATUSES), "unknown payment status")
        .when(undated("completed_date") | undated("payment_date"), "invalid date")
    )


def validate_events(df: DataFrame) -> DataFrame:
    """Canonical type, source and payment status (raw text kept), and ``reject_reason``."""
    reason = invalid_reason(df)
    raw = F.trim(_column(df, "payment_status"))
    kept = F.coalesce(_column(df, "payment_status_raw"), raw)
    return df.withColumns(
        {
            "reject_reason": reason,
            "event_type": F.when(reason.isNull(), F.upper("event_type")).otherwise(F.col("event_type")),
            "event_source": F.when(reason.isNull(), F.lower("event_source")).otherwise(F.col("event_source")),
            "payment_status": stream_payment_status(_column(df, "payment_status")),
            "payment_status_raw": kept,
        }
    )


def gate_events(df: DataFrame) -> DataFrame:
    """Unmapped events are skipped before validation; the rest is valid or invalid: ``event_status`` and reason."""
    mapping = F.lower(_column(df, "mapping_status"))
    skipped = F.coalesce(mapping.isin("unresolved", "ambiguous"), F.lit(False))
    checked = validate_events(df)
    status = F.when(skipped, "skipped").when(F.col("reject_reason").isNotNull(), "invalid").otherwise("processed")
    reason = F.when(skipped, F.concat(mapping, F.lit(" project mapping"))).otherwise(F.col("reject_reason"))
    return checked.withColumns({"event_status": status, "reject_reason": reason})


def route_events(df: DataFrame, order: str) -> DataFrame:
    """Batch routing: of the valid events with one id the first in ``order`` is processed, the others are duplicates.

    First occurrences are an aggregate by id, so repeated ids are never gathered.
    """
    gated = gate_events(df)
    first = gated.filter("event_status = 'processed'").groupBy("event_id").agg(F.min(order).alias("__first"))
    repeated = (F.col("event_status") == "processed") & (F.col(order) > F.col("__first"))
    return gated.join(first, "event_id", "left").withColumns(
        {
            "event_status": F.when(repeated, "duplicate").otherwise(F.col("event_status")),
            "reject_reason": F.when(repeated, "duplicate event_id").otherwise(F.col("reject_reason")),
        }
    ).drop("__first")


def status_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("event_status").agg(F.count("*").alias("events"))


def progress_counts(routed: DataFrame) -> DataFrame:
    """Total, processed, remaining, duplicate, invalid and skipped events and the last processed time."""
    n = lambda s: F.count_if(F.col("event_status") == s)
    return routed.agg(
        F.count("*").alias("events_total"), n("processed").alias("events_processed"),
        (F.count("*") - n("processed")).alias("events_remaining"), n("duplicate").alias("duplicate_events"),
        n("invalid").alias("invalid_events"), n("skipped").alias("skipped_events"),
        F.max(F.when(F.col("event_status") == "processed", F.col("event_timestamp"))).alias("latest_event_timestamp"),
    )


ORDER = ["event_timestamp", "event_type", "event_id"]


def _state_parts() -> tuple[dict[str, tuple[Column, Column]], Column]:
    """Per field of a project's state that keeps the latest value: the value of an event, and whether the event carries one."""
    kind = F.col("event_type")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    status = (
        F.when(kind.isin("PROJECT_CREATED", "PROJECT_RECOMMENDED"), F.coalesce(text("project_status"), F.lit("recommended")))
        .when(kind == "PROJECT_STATUS_UPDATED", text("project_status"))
        .when(kind == "PROJECT_COMPLETED", "completed")
    )
    paid = kind == "PAYMENT_RECEIVED"
    payment = F.when(kind.isin("PAYMENT_RECEIVED", "PAYMENT_STATUS_UPDATED"), F.lower(text("payment_status")))
    carried = lambda c: (c, c.isNotNull())
    fields = {
        "current_status": carried(status), "recommended_amount": carried(F.col("recommended_amount")), "final_amount": carried(F.col("final_amount")),
        "latest_payment_status": carried(payment), "completed_date": (F.col("completed_date"), kind == "PROJECT_COMPLETED"),
        **{c: carried(text(c)) for c in ("mp_name", "state", "constituency")},
    }
    return fields, paid


def partial_state(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Per project what its events say, in a form that can be merged: each latest value with its place, sums and counts."""
    fields, paid = _state_parts()
    at = F.struct(*(order or ORDER))
    latest = [F.max(F.when(has, F.struct(at.alias("at"), value.alias("value")))).alias(name) for name, (value, has) in fields.items()]
    return events.groupBy("project_id").agg(
        *latest, F.sum(F.when(paid, F.col("expenditure_amount").cast("decimal(18,2)"))).cast("decimal(28,2)").alias("total_expenditure"),
        F.count_if(paid).alias("payment_count"), F.max("event_timestamp").alias("latest_event_timestamp"),
    )


def merge_partial(parts: DataFrame) -> DataFrame:
    """One partial state per project from several; events must not be counted in two of them."""
    latest = [F.max(c).alias(c) for c in _state_parts()[0]]
    return parts.groupBy("project_id").agg(
        *latest, F.sum("total_expenditure").cast("decimal(28,2)").alias("total_expenditure"), F.sum("payment_count").alias("payment_count"),
        F.max("latest_event_timestamp").alias("latest_event_timestamp"),
    )


def finished_state(parts: DataFrame) -> DataFrame:
    """State per project: last values by event time, running spend and payment count."""
    value = lambda c: F.col(c)["value"]
    return parts.select(
        "project_id",
        F.coalesce(value("current_status"), F.lit("new")).alias("current_status"),
        F.coalesce(value("recommended_amount"), F.lit(0.0)).alias("recommended_amount"),
        F.coalesce(value("final_amount"), F.lit(0.0)).alias("final_amount"),
        F.coalesce(F.col("total_expenditure").cast("double"), F.lit(0.0)).alias("total_expenditure"),
        "payment_count",
        F.coalesce(value("latest_payment_status"), F.lit("unknown")).alias("latest_payment_status"),
        "latest_event_timestamp",
        value("completed_date").alias("completed_date"),
        *[value(c).alias(c) for c in ("mp_name", "state", "constituency")],
    )


def project_state(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """State per project over all its events."""
    return finished_state(partial_state(events, order))


def mp_state(state: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.trim("mp_name"), F.lit("")), F.lit("Unknown MP"))
    return state.groupBy(name.alias("mp_name")).agg(
        F.count("*").alias("project_count"),
        F.sum(F.col("total_expenditure").cast("decimal(18,2)")).cast("double").alias("expenditure_total"),
        F.sum("payment_count").alias("payment_count"),
        F.count_if(F.lower("current_status") == "completed").alias("completed_count"),
    )


def filter_states(state: DataFrame, area: str | None = None, constituency: str | None = None, status: str | None = None) -> DataFrame:
    keep = F.lit(True)
    for column, value in (("state", area), ("constituency", constituency), ("current_status", status)):
        if value:
            keep &= F.lower(F.trim(column)) == value.strip().lower()
    return state.filter(keep)


def dashboard(state: DataFrame) -> DataFrame:
    """Totals over the project states as (metric, value), with the number of projects per status."""
    waiting = F.col("latest_payment_status").isin(WAITING)
    totals = state.agg(
        F.count("*").cast("double").alias("total_projects"), F.sum("payment_count").cast("double").alias("payments_processed"),
        F.count_if(F.lower("current_status") == "completed").cast("double").alias("completed_projects"),
        F.count_if(waiting).cast("double").alias("pending_payments"),
        F.sum(F.col("total_expenditure").cast("decimal(18,2)")).cast("double").alias("total_expenditure"),
    )
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in totals.columns])
    per_status = state.groupBy("current_status").agg(F.count("*").cast("double").alias("value"))
    named = per_status.select(F.concat(F.lit("status:"), F.col("current_status")).alias("metric"), "value")
    return union_all([totals.select(F.inline(rows)), named])


def latest_events(log: DataFrame, n: int = 5) -> DataFrame:
    return log.orderBy(F.desc("event_timestamp"), F.desc("event_type"), F.desc("event_id")).limit(n)


def project_history(log: DataFrame, project_id: str) -> DataFrame:
    return log.filter(F.col("project_id") == project_id).orderBy("event_timestamp", "event_type", "event_id")
