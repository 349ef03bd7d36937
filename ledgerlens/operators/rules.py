"""Compliance, stalled-work and progress rules as struct Columns.

A rule is a function from a payload (name -> Column) to one struct; a suite is an array of them, so a
whole evaluation is a single projection.  Users add rules with ``register_rule``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import strict_date
from ledgerlens.functions.numbers import ladder, money, plain, rounded, safe_float, safe_int, severity_score
from ledgerlens.functions.text import is_blank

# Field names, statuses and gap thresholds of the published rule set.
CRITICAL_FIELDS = [
    "project_id", "project_name", "sanctioned_amount", "start_date", "status", "location", "implementing_agency",
]
ALLOWED_STATUSES = [
    "ongoing", "completed", "cancelled", "pending", "in progress", "active", "not started", "sanctioned", "closed",
]
ACTIVE_STATUSES = ["ongoing", "active", "in progress", "in-progress", "started"]
FINANCIAL_FIELDS = ["sanctioned_amount", "actual_expenditure", "payment_amount", "total_payments", "released_amount"]
GAP_THRESHOLDS = {"LOW": 15.0, "MEDIUM": 30.0, "HIGH": 50.0, "CRITICAL": 70.0}

Payload = dict[str, Column]
Rule = Callable[[Payload], Column]


def text(*parts: object) -> Column:
    """Join text and columns; numbers print in their shortest form."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def rule_result(
    rule_id: str, name: str, category: str, triggered: Column, severity: Column | str, message: Column | str,
    evidence: dict[str, Column] | None = None, score: Column | None = None,
) -> Column:
    """The common result struct; severity falls to LOW and the score to 0 when the rule does not trigger."""
    fired = F.coalesce(triggered, F.lit(False))
    level = severity if isinstance(severity, Column) else F.lit(severity)
    facts = [c.alias(k) for k, c in (evidence or {}).items()]
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(name).alias("rule_name"),
        F.lit(category).alias("category"),
        fired.alias("triggered"),
        F.when(fired, level).otherwise(F.lit("LOW")).alias("severity"),
        (severity_score(level, fired) if score is None else score.cast("long")).alias("score"),
        (message if isinstance(message, Column) else F.lit(message)).alias("message"),
        (F.to_json(F.struct(*facts), {"ignoreNullFields": "false"}) if facts else F.lit("{}")).alias("evidence"),
    )


def field(p: Payload, name: str) -> Column:
    return p.get(name, F.lit(None).cast("string"))


# Parsed values that several rules share.  ``prepare`` computes each once as a column; a payload without
# them works too, at the price of repeating the expression.
DATE_FIELDS = ["start_date", "completion_date", "expected_completion_date", "last_progress_update"]


def progress_of(p: Payload) -> Column:
    if "__done" in p:
        return p["__done"]
    return F.coalesce(safe_float(field(p, "progress_percentage")), safe_float(field(p, "progress")))


def state_of(p: Payload) -> Column:
    if "__state" in p:
        return p["__state"]
    return F.lower(F.trim(F.coalesce(field(p, "status").cast("string"), F.lit(""))))


def day(p: Payload, name: str) -> Column:
    return p[f"__{name}"] if f"__{name}" in p else strict_date(field(p, name))


def prepare(df: DataFrame, now: Column) -> tuple[DataFrame, Payload]:
    """Add the shared parsed columns; returns the frame and its payload."""
    p = payload_of(df)
    df = df.withColumns({"__done": progress_of(p), "__state": state_of(p)} | {f"__{d}": day(p, d) for d in DATE_FIELDS})
    p = payload_of(df)
    df = df.withColumns({"__idle": days_since(p, now), "__share": elapsed_share(p, now)})
    df = df.withColumn("__expected", expected_progress(payload_of(df), now))
    df = df.withColumn("__gap", progress_gap(F.col("__expected"), F.col("__done")))
    return df, payload_of(df)


# --- compliance -----------------------------------------------------------------------------------


def missing_fields(p: Payload, fields: list[str] = CRITICAL_FIELDS, present: tuple[str, ...] = ()) -> Column:
    """``present`` names fields whose nulls still count as given (numeric NaN in the published runs)."""
    if "__missing" in p:
        return p["__missing"]
    return F.array_compact(F.array(*[F.when(is_blank(field(p, f)) & F.lit(f not in present), F.lit(f)) for f in fields]))


def missing_critical_fields(p: Payload, fields: list[str] = CRITICAL_FIELDS, present: tuple[str, ...] = ()) -> Column:
    missing = missing_fields(p, fields, present)
    n = F.size(missing)
    message = F.when(
        n > 0,
        text("Project record is missing ", n.cast("string"), " critical field(s): ", F.array_join(missing, ", "), "."),
    ).otherwise("All critical project fields are present.")
    return rule_result(
        "COMPLIANCE-001", "Missing critical project information", "COMPLIANCE", n > 0,
        F.when(n > 1, "HIGH").otherwise("MEDIUM"), message,
        {"missing_fields": missing, "checked_fields_count": F.lit(len(fields)), "missing_count": n},
    )


def invalid_status(p: Payload, allowed: list[str] = ALLOWED_STATUSES) -> Column:
    status = field(p, "status")
    blank = is_blank(status)
    known = F.coalesce(state_of(p).isin(allowed), F.lit(False))
    message = (
        F.when(blank, "Project status is missing or empty.")
        .when(~known, text("Project status '", status, "' is not recognized among valid status values."))
        .otherwise(text("Project status '", status, "' is valid."))
    )
    return rule_result(
        "COMPLIANCE-002", "Invalid project status", "COMPLIANCE", blank | ~known, "MEDIUM", message,
        {"reported_status": status, "normalized_status": state_of(p), "allowed_statuses": F.array(*map(F.lit, sorted(allowed)))},
    )


def invalid_progress(p: Payload) -> Column:
    done = progress_of(p)
    outside = (done < 0) | (done > 100)
    message = (
        F.when(done.isNull(), "Progress percentage is not provided or unparseable; not evaluated.")
        .when(outside, text("Reported progress percentage (", plain(done), "%) is out of valid bounds [0.0, 100.0]."))
        .otherwise(text("Reported progress percentage (", plain(done), "%) is within valid bounds."))
    )
    return rule_result(
        "COMPLIANCE-003", "Invalid progress percentage", "COMPLIANCE", outside, "HIGH", message,
        {"progress_percentage": done, "lower_bound": F.lit(0.0), "upper_bound": F.lit(100.0)},
    )


def negative_financials(p: Payload, fields: list[str] = FINANCIAL_FIELDS) -> Column:
    values = F.create_map(*[x for f in fields for x in (F.lit(f), safe_float(field(p, f)))])
    negative = F.map_filter(values, lambda _, v: v < 0)
    listed = F.array_join(F.transform(F.map_entries(negative), lambda e: text(e["key"], "=", plain(e["value"]))), ", ")
    some = F.size(negative) > 0
    message = F.when(some, text("Found negative financial value(s): ", listed, ".")).otherwise(
        "All checked financial values are non-negative."
    )
    return rule_result(
        "COMPLIANCE-004", "Negative financial values", "COMPLIANCE", some, "HIGH", message, {"negative_financials": negative}
    )


def invalid_dates(p: Payload) -> Column:
    start = day(p, "start_date")
    labels = {
        "completion_date": "Actual completion date",
        "expected_completion_date": "Expected completion date",
        "last_progress_update": "Last progress update date",
    }
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    day(p, f) < start,
                    text(label, " (", day(p, f).cast("string"), ") is earlier than start date (", start.cast("string"), ")"),
                )
                for f, label in labels.items()
            ]
        )
    )
    some = F.size(found) > 0
    message = F.when(
        some, text("Chronological inconsistency in project dates: ", F.array_join(found, "; "), ".")
    ).otherwise("Project milestone dates are chronologically consistent.")
    evidence = {f: day(p, f) for f in ["start_date", *labels]} | {"anomalies": found}
    return rule_result("COMPLIANCE-005", "Invalid dates chronology", "COMPLIANCE", some, "HIGH", message, evidence)


def completed_progress_mismatch(p: Payload) -> Column:
    done, finished = progress_of(p), state_of(p) == "completed"
    message = (
        F.when(~finished, text("Project status is '", shown(field(p, "status")), "', not 'completed'. Rule not triggered."))
        .when(done.isNull(), "Project is marked completed, but progress percentage is missing.")
        .when(done < 100, text("Project is marked 'completed' but reported progress is only ", plain(done), "% (expected 100%)."))
        .otherwise("Project is marked 'completed' and reports 100% progress.")
    )
    return rule_result(
        "COMPLIANCE-006", "Completed project with progress below 100%", "COMPLIANCE",
        finished & (done.isNull() | (done < 100)), F.when(done.isNull(), "MEDIUM").otherwise("HIGH"), message,
        {"status": field(p, "status"), "progress_percentage": done, "expected_progress": F.lit(100.0)},
    )


def completed_without_date(p: Payload) -> Column:
    end, finished = day(p, "completion_date"), state_of(p) == "completed"
    message = (
        F.when(~finished, text("Project status is '", shown(field(p, "status")), "', not 'completed'. Rule not triggered."))
        .when(end.isNull(), "Project is marked 'completed' but no valid completion date is recorded.")
        .otherwise(text("Project is marked 'completed' with recorded completion date ", end.cast("string"), "."))
    )
    return rule_result(
        "COMPLIANCE-007", "Completed project with missing completion date", "COMPLIANCE", finished & end.isNull(),
        "MEDIUM", message, {"status": field(p, "status"), "completion_date": end},
    )


def payment_inconsistency(p: Payload) -> Column:
    spent = safe_float(field(p, "actual_expenditure"))
    paid = F.coalesce(safe_float(field(p, "total_payments")), safe_float(field(p, "payment_amount")))
    excess = rounded(paid - spent, 2)
    message = (
        F.when(excess.isNull(), "Insufficient expenditure or payment data to evaluate consistency.")
        .when(
            excess > 0.01,
            text("Total payments (INR ", money(paid), ") exceed reported actual expenditure (INR ", money(spent),
                 ") by INR ", money(excess), "."),
        )
        .otherwise(text("Payments (INR ", money(paid), ") are within reported actual expenditure (INR ", money(spent), ")."))
    )
    return rule_result(
        "COMPLIANCE-008", "Payment/expenditure inconsistency", "COMPLIANCE", excess > 0.01, "HIGH", message,
        {"actual_expenditure": spent, "total_payments": paid, "excess_amount": F.when(excess > 0.01, excess).otherwise(0.0)},
    )


# --- stalled work ---------------------------------------------------------------------------------


def days_since(p: Payload, now: Column) -> Column:
    """Days since the last update, or since the start; never negative."""
    if "__idle" in p:
        return p["__idle"]
    last = F.coalesce(day(p, "last_progress_update"), day(p, "start_date"))
    return F.when(last.isNotNull(), F.greatest(F.lit(0), F.datediff(now, last)))


def no_progress(p: Payload, now: Column, low: float = 5.0, stalled_days: int = 120) -> Column:
    done, idle = progress_of(p), days_since(p, now)
    fired = (done <= low) & (idle >= stalled_days)
    message = (
        F.when(done.isNull(), "Progress percentage is missing; unable to evaluate no-progress rule.")
        .when(idle.isNull(), "Reference date (last update or start date) is missing; unable to calculate duration.")
        .when(
            fired,
            text("Project has shown no meaningful progress (", plain(done), "%) for ", idle.cast("string"),
                 f" days (threshold: {stalled_days} days)."),
        )
        .otherwise(
            text("Project progress activity is within normal expectations (", plain(done), "% progress, ",
                 idle.cast("string"), " days since update).")
        )
    )
    return rule_result(
        "GHOST-001", "No-progress detection", "GHOST_STALLED", fired, "HIGH", message,
        {"progress_percentage": done, "days_since_update": idle, "low_progress_threshold": F.lit(low),
         "stalled_days_threshold": F.lit(stalled_days), "current_date": now},
    )


def spend_progress_mismatch(p: Payload, ratio_limit: float = 0.5, low: float = 20.0) -> Column:
    spent, budget, done = (
        safe_float(field(p, "actual_expenditure")),
        safe_float(field(p, "sanctioned_amount")),
        progress_of(p),
    )
    ratio = F.when(spent.isNotNull() & budget.isNotNull(), F.coalesce(F.try_divide(spent, budget), F.lit(0.0)))
    pct = rounded(ratio * 100, 2)
    enough = ratio.isNotNull() & done.isNotNull()
    fired = (ratio >= ratio_limit) & (done <= low)
    message = (
        F.when(~enough, "Insufficient expenditure, sanctioned budget, or progress data to evaluate mismatch.")
        .when(
            fired,
            text("High expenditure with comparatively low reported progress: INR ", money(spent), " spent (", plain(pct),
                 "% of sanctioned INR ", money(budget), ") with only ", plain(done), "% physical progress completed."),
        )
        .otherwise(
            text("Expenditure and progress relationship is within expected tolerance (", plain(pct), "% budget spent, ",
                 plain(done), "% progress).")
        )
    )
    return rule_result(
        "GHOST-002", "Expenditure-progress mismatch", "GHOST_STALLED", enough & fired,
        F.when((ratio >= 0.75) & (done <= 15), "CRITICAL").otherwise("HIGH"), message,
        {"actual_expenditure": spent, "sanctioned_amount": budget, "expenditure_ratio": rounded(ratio, 4),
         "expenditure_percentage": pct, "progress_percentage": done, "expenditure_ratio_threshold": F.lit(ratio_limit),
         "low_progress_threshold": F.lit(low)},
    )


def active_inactivity(p: Payload, now: Column, limit: int = 90) -> Column:
    active, idle = state_of(p).isin(ACTIVE_STATUSES), days_since(p, now)
    status = shown(field(p, "status"))
    message = (
        F.when(~active, text("Project status is '", status, "', not in active/ongoing states. Rule not triggered."))
        .when(idle.isNull(), "Active project is missing update and start dates; cannot measure inactivity period.")
        .when(
            idle >= limit,
            text("Project is marked as '", status, "' but has had no reported progress or updates for ",
                 idle.cast("string"), f" days (inactivity threshold: {limit} days)."),
        )
        .otherwise(
            text("Active project has recent activity (", idle.cast("string"),
                 f" days since update, within threshold of {limit} days).")
        )
    )
    return rule_result(
        "GHOST-003", "Active project with no recent activity", "GHOST_STALLED", active & (idle >= limit),
        F.when(idle >= 2 * limit, "HIGH").otherwise("MEDIUM"), message,
        {"status": field(p, "status"), "days_inactive": idle, "max_inactive_days": F.lit(limit), "current_date": now},
    )


def elapsed_share(p: Payload, now: Column) -> Column:
    """Elapsed share of the planned schedule in percent, not above-clamped; 100 when the plan has no length."""
    if "__share" in p:
        return p["__share"]
    start, end = day(p, "start_date"), day(p, "expected_completion_date")
    planned, gone = F.datediff(end, start), F.datediff(now, start)
    flat = F.when(gone >= 0, 100.0).otherwise(0.0)
    share = rounded(F.greatest(F.lit(0.0), gone / planned * 100), 2)
    return F.when(planned <= 0, flat).when(planned > 0, share)


def stalled_composite(
    p: Payload, now: Column, low: float = 20.0, idle_days: int = 90, elapsed_limit: float = 50.0
) -> Column:
    done, idle, share = progress_of(p), F.coalesce(days_since(p, now), F.lit(0)), elapsed_share(p, now)
    enough = done.isNotNull() & share.isNotNull()
    tests = [done <= low, idle >= idle_days, share >= elapsed_limit]
    fired = reduce(lambda a, b: a & b, tests)
    message = (
        F.when(
            ~enough,
            "Insufficient data (progress, start date, or completion date missing) to evaluate composite stall indicator.",
        )
        .when(
            fired,
            text("Strong stalled-project indicator: Project has low progress (", plain(done), "%), has been inactive for ",
                 idle.cast("string"), " days, and has consumed ", plain(share), "% of planned schedule."),
        )
        .otherwise(
            text("Composite stalled indicator not met (progress: ", plain(done), "%, inactive: ", idle.cast("string"),
                 "d, elapsed schedule: ", plain(share), "%).")
        )
    )
    return rule_result(
        "GHOST-004", "Stalled project composite indicator", "GHOST_STALLED", enough & fired, "CRITICAL", message,
        {"progress_percentage": done, "days_inactive": idle, "elapsed_duration_percentage": share,
         "progress_threshold": F.lit(low), "inactivity_days_threshold": F.lit(idle_days),
         "elapsed_duration_pct_threshold": F.lit(elapsed_limit),
         "criteria_met": F.struct(tests[0].alias("low_progress"), tests[1].alias("long_inactivity"),
                                  tests[2].alias("high_elapsed_duration"))},
    )


# --- progress -------------------------------------------------------------------------------------


def expected_progress(p: Payload, now: Column) -> Column:
    """Percentage of the schedule that has passed, within 0..100."""
    if "__expected" in p:
        return p["__expected"]
    return F.when(elapsed_share(p, now).isNotNull(), F.least(F.lit(100.0), elapsed_share(p, now)))


def progress_gap(expected: Column, actual: Column) -> Column:
    return rounded(expected - actual, 2)


def expected_progress_rule(p: Payload, now: Column) -> Column:
    expected = expected_progress(p, now)
    message = F.when(
        expected.isNull(), "Cannot calculate expected progress due to missing start or expected completion date."
    ).otherwise(text("Calculated expected progress is ", plain(expected), "% based on elapsed timeline."))
    return rule_result(
        "PROGRESS-001", "Expected progress estimation", "PROGRESS", F.lit(False), "LOW", message,
        {"start_date": day(p, "start_date"), "expected_completion_date": day(p, "expected_completion_date"),
         "current_date": now, "expected_progress": expected},
    )


def significant_gap(p: Payload, now: Column, thresholds: dict[str, float] | None = None) -> Column:
    limits = GAP_THRESHOLDS | (thresholds or {})
    expected, actual = expected_progress(p, now), progress_of(p)
    gap = p["__gap"] if "__gap" in p else progress_gap(expected, actual)
    e, a, g = plain(expected), plain(actual), plain(gap)
    message = (
        F.when(gap.isNull(), "Insufficient data to compute progress gap.")
        .when(gap >= limits["CRITICAL"], text("Critical progress gap: actual progress (", a, "%) lags expected progress (", e, "%) by ", g, " percentage points."))
        .when(gap >= limits["HIGH"], text("High progress gap: actual progress (", a, "%) is substantially below expected progress (", e, "%) by ", g, " percentage points."))
        .when(gap >= limits["MEDIUM"], text("Moderate progress gap: actual progress (", a, "%) lags expected progress (", e, "%) by ", g, " percentage points."))
        .when(gap >= limits["LOW"], text("Minor progress gap: actual progress (", a, "%) is ", g, " percentage points behind expected progress (", e, "%)."))
        .when(gap < 0, text("Project is ahead of schedule by ", plain(F.abs(gap)), " percentage points (actual: ", a, "%, expected: ", e, "%)."))
        .otherwise(text("Progress gap is within acceptable limits (", g, " percentage points; actual: ", a, "%, expected: ", e, "%)."))
    )
    steps = [(limits[s], s) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]
    return rule_result(
        "PROGRESS-003", "Significant progress gap", "PROGRESS", gap >= limits["LOW"], ladder(gap, steps, "LOW"), message,
        {"expected_progress": expected, "actual_progress": actual, "progress_gap": gap,
         "applied_thresholds": F.struct(*[F.lit(v).alias(k) for k, v in limits.items()])},
    )


def duration_mismatch(p: Payload, now: Column, elapsed_limit: float = 75.0, low: float = 25.0) -> Column:
    share, done = elapsed_share(p, now), progress_of(p)
    fired = (share >= elapsed_limit) & (done <= low)
    message = (
        F.when(share.isNull() | done.isNull(), "Insufficient date or progress data to evaluate progress/duration mismatch.")
        .when(
            fired,
            text("High duration/progress mismatch: ", plain(share), "% of project schedule has elapsed, but only ",
                 plain(done), "% physical progress has been reported."),
        )
        .otherwise(
            text("Progress duration alignment is acceptable (", plain(share), "% elapsed, ", plain(done), "% completed).")
        )
    )
    start = day(p, "start_date")
    return rule_result(
        "PROGRESS-004", "Progress and duration mismatch", "PROGRESS", fired,
        F.when((share >= 90) & (done <= 15), "CRITICAL").otherwise("HIGH"), message,
        {"elapsed_duration_percentage": share, "actual_progress_percentage": done,
         "duration_threshold_percentage": F.lit(elapsed_limit), "progress_threshold_percentage": F.lit(low),
         "elapsed_days": F.datediff(now, start), "total_planned_days": F.datediff(day(p, "expected_completion_date"), start)},
    )


# --- suites ---------------------------------------------------------------------------------------

EXTRA_RULES: list[Rule] = []


def register_rule(rule: Rule) -> Rule:
    """Add a user's rule (payload -> struct from ``rule_result``) to every suite; usable as a decorator."""
    EXTRA_RULES.append(rule)
    return rule


def compliance_suite(p: Payload) -> list[Column]:
    checks = [
        missing_critical_fields, invalid_status, invalid_progress, negative_financials, invalid_dates,
        completed_progress_mismatch, completed_without_date, payment_inconsistency,
    ]
    return [check(p) for check in checks]


def stalled_suite(p: Payload, now: Column) -> list[Column]:
    return [no_progress(p, now), spend_progress_mismatch(p), active_inactivity(p, now), stalled_composite(p, now)]


def progress_suite(p: Payload, now: Column) -> list[Column]:
    return [
        expected_progress_rule(p, now),
        significant_gap(p, now),
        duration_mismatch(p, now),
    ]


def payload_of(df: DataFrame) -> Payload:
    return {c: F.col(c) for c in df.columns}


def evaluate_records(df: DataFrame, as_of: str) -> DataFrame:
    """All suites on records that carry the payload's columns: one ``findings`` array per row."""
    now = F.lit(as_of).cast("date")
    ready, p = prepare(df, now)
    found = compliance_suite(p) + stalled_suite(p, now) + progress_suite(p, now) + [r(p) for r in EXTRA_RULES]
    return ready.select(*df.columns, F.array(*found).alias("findings"))


def feature_values(p: Payload) -> Payload:
    """Values of the project features that several rules share, under ``__`` names; those that ``p`` has as columns are kept."""
    category, area = (F.trim(F.coalesce(p[c], F.lit(""))) for c in ("category", "constituency"))
    named = F.when((category != "") | (area != ""), text(category, " in ", area))
    title = F.coalesce(F.nullif(p["work_description"], F.lit("")), named) if "work_description" in p else named
    paid = F.when(p["average_payment"].isNotNull() & (p["payment_count"] > 0), p["payment_count"] * p["average_payment"])
    values = {
        "__finished": safe_int(p["is_completed"], 0) == 1,
        "__ratio": safe_float(p["expenditure_ratio"], 0.0),
        "__gone": safe_float(p["days_since_recommendation"]),
        "__took": safe_float(p["recommendation_to_completion_days"]),
        "__spent": safe_float(p["total_expenditure"], 0.0),
        "__budget": safe_float(p["recommended_amount"], 0.0),
        "__title": title,
        "__paid": F.coalesce(paid, p["total_expenditure"]),
        "__place": F.regexp_replace(F.concat(area, F.lit(", "), F.coalesce(p["state"], F.lit(""))), "^[, ]+|[, ]+$", ""),
    }
    return {name: p.get(name, c) for name, c in values.items()}


def feature_payload(p: Payload) -> Payload:
    """Project features under the names of the records' fields."""
    null = F.lit(None).cast("string")
    v = feature_values(p)
    status = F.when(v["__finished"], "completed").otherwise("ongoing")
    return (
        {
            "project_id": p["project_id"],
            "project_name": v["__title"],
            "sanctioned_amount": p["recommended_amount"],
            "actual_expenditure": p["total_expenditure"],
            "status": status,
            "location": v["__place"],
            "total_payments": v["__paid"],
            "payment_amount": p["maximum_payment"],
            "__state": status,
            "__done": null.cast("double"),
            "__idle": null.cast("int"),
            "__share": null.cast("double"),
            "__expected": null.cast("double"),
            "__gap": null.cast("double"),
        }
        | {f"__{d}": null.cast("date") for d in DATE_FIELDS}
        | ({"__missing": p["__missing"]} if "__missing" in p else {})
    )


def given_fields(nan_is_present: bool) -> tuple[str, ...]:
    return ("sanctioned_amount",) if nan_is_present else ()


def dataset_findings(p: Payload, critical_fields: list[str] = CRITICAL_FIELDS, nan_is_present: bool = False) -> list[Column]:
    """The 15 evaluations on project features, which lack progress and dates.

    Chronology, completion, overrun and inactivity use the elapsed-day features instead.
    ``nan_is_present`` treats missing numbers as given, as the published runs did.
    """
    v, q = feature_values(p), feature_payload(p)
    finished, ratio, gone, took, spent, budget = (v[f"__{n}"] for n in ("finished", "ratio", "gone", "took", "spent", "budget"))
    status, given = q["status"], given_fields(nan_is_present)
    has_days = F.lit(True) if nan_is_present else took.isNotNull()
    early = took < 0
    dates = rule_result(
        "COMPLIANCE-005", "Invalid dates chronology", "COMPLIANCE", early, "HIGH",
        F.when(
            early,
            text("Chronological error: Recorded completion date preceded recommendation date by ",
                 F.abs(took.cast("long")).cast("string"), " days."),
        ).otherwise("Project milestone dates are chronologically consistent."),
        {"recommendation_to_completion_days": took,
         "anomaly_type": F.when(early, "completion_before_recommendation")},
    )
    undated = rule_result(
        "COMPLIANCE-007", "Completed project with missing completion date", "COMPLIANCE", finished & ~has_days, "MEDIUM",
        F.when(~finished, "Project status is 'ongoing', not 'completed'. Rule not triggered.")
        .when(has_days, "Project is marked 'completed' with recorded completion duration.")
        .otherwise("Project is marked 'completed' but completion interval data is missing."),
        {"status": status, "has_completion_record": has_days, "recommendation_to_completion_days": took},
    )
    over = (ratio > 1) & (budget > 0)
    over_pct = rounded((ratio - 1) * 100, 2)
    overrun = rule_result(
        "GHOST-002", "Expenditure-progress mismatch", "GHOST_STALLED", over,
        F.when(ratio >= 1.5, "CRITICAL").otherwise("HIGH"),
        F.when(
            over,
            text("High expenditure relative to budget: INR ", money(spent), " spent exceeds sanctioned amount (INR ",
                 money(budget), ") by ", plain(over_pct), "% (expenditure_ratio=", plain(rounded(ratio, 4)), ")."),
        ).otherwise("Insufficient expenditure, sanctioned budget, or progress data to evaluate mismatch."),
        {"actual_expenditure": spent, "sanctioned_amount": budget, "expenditure_ratio": rounded(ratio, 4),
         "overrun_percentage": F.when(over, over_pct)},
    )
    idle = ~finished & (gone >= 90)
    inactive = rule_result(
        "GHOST-003", "Active project with no recent activity", "GHOST_STALLED", idle,
        F.when(gone >= 180, "HIGH").otherwise("MEDIUM"),
        F.when(
            idle,
            text("Project is marked as 'ongoing' but has had no completion or update for ",
                 gone.cast("long").cast("string"), " days (inactivity threshold: 90 days)."),
        )
        .when(finished, "Project status is 'completed', not in active/ongoing states. Rule not triggered.")
        .otherwise("Active project is missing update and start dates; cannot measure inactivity period."),
        {"status": status, "days_since_recommendation": gone, "inactivity_threshold_days": F.lit(90)},
    )
    now = F.lit(None).cast("date")
    return [
        missing_critical_fields(q, critical_fields, given),
        invalid_status(q),
        invalid_progress(q),
        negative_financials(q),
        dates,
        completed_progress_mismatch(q),
        undated,
        payment_inconsistency(q),
        no_progress(q, now),
        overrun,
        inactive,
        stalled_composite(q, now),
        *progress_suite(q, now),
        *[r(p) for r in EXTRA_RULES],
    ]


def evaluate_features(df: DataFrame, triggered_only: bool = False, **options) -> DataFrame:
    """Project features plus their ``findings``; texts of rules that do not trigger are skipped on request."""
    ready, p = prepare_features(df, **options)
    found = dataset_findings(p, **options)
    findings = F.array_compact(F.array(*[F.when(f["triggered"], f) for f in found])) if triggered_only else F.array(*found)
    return ready.select(*df.columns, findings.alias("findings"))


def prepare_features(df: DataFrame, critical_fields: list[str] = CRITICAL_FIELDS, nan_is_present: bool = False) -> tuple[DataFrame, Payload]:
    """Add the shared values, so that each is worked out once a row; returns the frame and its payload."""
    df = df.withColumns(feature_values(payload_of(df)))
    q = feature_payload(payload_of(df))
    df = df.withColumn("__missing", missing_fields(q, critical_fields, given_fields(nan_is_present)))
    return df, payload_of(df)


def rule_events(evaluated: DataFrame, all_results: bool = False) -> DataFrame:
    """One row per triggered rule (or per evaluation)."""
    # generating from an expression keeps Spark from testing the array's size, and so evaluating the rules, beforehand
    wanted = F.filter("findings", lambda f: F.lit(True) if all_results else f["triggered"])
    return evaluated.select("project_id", F.inline(wanted)).select(
        "project_id", "rule_id", "rule_name", "category", "triggered",
        F.when(F.col("triggered"), F.col("severity")).otherwise("NONE").alias("severity"),
        "score", F.col("message").alias("reason"), "evidence",
    )


def project_rollup(evaluated: DataFrame) -> DataFrame:
    """Score, band, ids, first three reasons and evidence per project, from the row's own array: no shuffle."""
    fired = F.filter("findings", lambda f: f["triggered"])
    base = evaluated.withColumn("__fired", fired)
    score = F.aggregate("__fired", F.lit(0).cast("long"), lambda acc, f: acc + f["score"])
    has = lambda level: F.exists("__fired", lambda f: f["severity"] == level)
    band = (
        F.when(F.size("__fired") == 0, "CLEAN")
        .when(has("CRITICAL") | (score >= 120), "CRITICAL_RISK")
        .when(has("HIGH") | (score >= 70), "HIGH_RISK")
        .when(has("MEDIUM") | (score >= 40), "MEDIUM_RISK")
        .otherwise("LOW_RISK")
    )
    return base.withColumns(
        {
            "rule_risk_score": score,
            "risk_band": band,
            "rules_triggered": F.array_join(F.transform("__fired", lambda f: f["rule_id"]), ";"),
            "rule_count": F.size("__fired").cast("long"),
            "top_reasons": F.array_join(F.slice(F.transform("__fired", lambda f: f["message"]), 1, 3), " | "),
            "rule_evidence": F.map_from_entries(
                F.transform("__fired", lambda f: F.struct(f["rule_id"], f["evidence"]))
            ),
        }
    ).drop("__fired", "findings")


ROLLUP = ["rule_risk_score", "risk_band", "rules_triggered", "rule_count", "top_reasons"]


def _flagged(rollup: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a triggered rule. A filter would be pushed below the rules and evaluate them once more."""
    row = F.struct(*columns)
    return rollup.select(F.inline(F.filter(F.array(row), lambda r: r["rule_count"] > 0)))


def flagged_projects(rollup: DataFrame) -> DataFrame:
    return _flagged(rollup, ["project_id", *ROLLUP])


def band_histogram(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("risk_band").agg(F.count("*").alias("projects"))


def rule_summary(evaluated: DataFrame) -> DataFrame:
    """Per rule: checked, triggered, rate and severity counts; the group key is one of the fixed rules."""
    levels = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    fired = F.col("triggered")
    return (
        evaluated.select(F.inline("findings"))
        .groupBy("rule_id", "rule_name")
        .agg(
            F.count("*").alias("projects_checked"),
            F.count_if(fired).alias("projects_triggered"),
            *[F.count_if(fired & (F.col("severity") == s)).alias(f"{s.lower()}_count") for s in levels],
        )
        .withColumn("trigger_rate", rounded(F.col("projects_triggered") / F.col("projects_checked") * 100, 2))
    )


HANDOFF = [
    "mp_name", "state", "constituency", "category", "recommended_amount", "final_amount", "total_expenditure",
    "expenditure_ratio", "payment_count", "days_since_recommendation", "is_completed", "description_similarity_score",
    "peer_median_cost", "cost_deviation_from_peer",
]
PLACEHOLDERS = [
    "ml_anomaly_score", "cost_anomaly_score", "delay_anomaly_score", "payment_anomaly_score", "gps_verification_status",
    "image_verification_status", "vendor_risk_score",
]


def verification_input(rollup: DataFrame, similarity: DataFrame | None = None) -> DataFrame:
    """Flagged projects with evidence, source features and empty columns for later engines.

    ``similarity`` (project_id, similarity_anomaly_score, similarity_risk_band) fills the similarity columns.
    """
    base = _flagged(rollup, ["project_id", *ROLLUP, "rule_evidence", *HANDOFF]).select(
        "project_id", *ROLLUP, F.to_json("rule_evidence").alias("rule_evidence"), *HANDOFF,
        *[F.lit(None).cast("string").alias(c) for c in PLACEHOLDERS],
    )
    if similarity is None:
        return base.withColumn("similarity_anomaly_score", F.lit(None).cast("double"))
    return base.join(similarity, "project_id", "left").withColumns(
        {
            "similarity_anomaly_score": F.coalesce("similarity_anomaly_score", F.lit(0.0)),
            "similarity_risk_band": F.coalesce("similarity_risk_band", F.lit("UNIQUE")),
        }
    )


def filter_events(
    events: DataFrame, project_id: str | None = None, rule_id: str | None = None, severity: str | None = None
) -> DataFrame:
    """Triggered events of a project, a rule or a severity."""
    keep = F.lit(True)
    if project_id:
        keep &= F.col("project_id") == project_id
    if rule_id:
        keep &= F.col("triggered") & (F.col("rule_id") == rule_id)
    if severity:
        keep &= F.col("triggered") & (F.col("severity") == severity.upper())
    return events.filter(keep)


# Severity order and weights of the event aggregate.
SEVERITY_ORDER = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "UNKNOWN": 0}
SEVERITY_WEIGHT = {"CRITICAL": 75.0, "HIGH": 50.0, "MEDIUM": 25.0, "LOW": 10.0, "UNKNOWN": 0.0}


def aggregate_rule_events(events: DataFrame) -> DataFrame:
    """Triggered events to one row per project: count, worst severity, weight, ids and reasons by severity.

    Ids and reasons come from the distinct (rule, reason) pairs, which the fixed rule set bounds.
    """
    level = F.upper(F.coalesce("severity", F.lit("LOW")))
    order = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_ORDER.items() for x in kv]), level), F.lit(1))
    weight = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_WEIGHT.items() for x in kv]), level), F.lit(10.0)
    )
    fired = events.filter(F.col("triggered").cast("int") == 1) if "triggered" in events.columns else events
    grouped = fired.groupBy("project_id").agg(
        F.count("rule_id").alias("rule_event_count"),
        F.max_by(level, order).alias("max_rule_severity"),
        F.max(weight).alias("max_rule_severity_score"),
        F.array_sort(F.collect_set(F.struct((-order).alias("o"), "rule_id", "reason"))).alias("__e"),
    )
    joined = lambda f: F.array_join(
        F.array_distinct(F.filter(F.transform("__e", lambda e: F.trim(e[f])), lambda x: x != "")), "; "
    )
    return grouped.withColumns({"rule_ids_triggered": joined("rule_id"), "rule_reasons_summary": joined("reason")}).drop("__e")

