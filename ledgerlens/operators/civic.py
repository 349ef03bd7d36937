"""Citizen votes and reports, and routed authority reports, as append-only actions reduced to their latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import rounded
from ledgerlens.operators.dashboard import order_columns, page_of, search
from ledgerlens.operators.fusion import lookup_join

# Concern vocabulary and the inbox of each addressed role.
CONCERNS = ["stalled", "quality", "cost", "ghost", "other"]
TARGET_TYPES = {"MP": "mp", "District Magistrate": "dm", "State Nodal Officer": "sno", "MoSPI Audit Cell": "mospi"}


# --- votes and reports ----------------------------------------------------------------------------


def current_votes(actions: DataFrame) -> DataFrame:
    """Each action flips a citizen's vote on a work; pairs with an odd number of actions stand, with the last reasons."""
    flips = actions.groupBy("citizen_id", "work_id").agg(
        F.count("*").alias("__n"), F.max_by("reasons", "action_id").alias("reasons"), F.max("action_id").alias("action_id")
    )
    return flips.filter("__n % 2 = 1").drop("__n")


def work_counts(votes: DataFrame, reports: DataFrame) -> DataFrame:
    """Votes and reports per work."""
    v = votes.groupBy("work_id").agg(F.count("*").alias("votes"))
    r = reports.groupBy("work_id").agg(F.count("*").alias("reports"))
    zero = F.lit(0).cast("long")
    return v.join(r, "work_id", "full").select(
        "work_id", F.coalesce("votes", zero).alias("votes"), F.coalesce("reports", zero).alias("reports")
    )


def concern_breakdown(votes: DataFrame, reports: DataFrame) -> DataFrame:
    """Per work and known concern: total, from reports, from votes."""
    tags = lambda df, c, source: df.select("work_id", F.explode(F.from_json(c, "array<string>")).alias("reason"), F.lit(source).alias("s"))
    rows = tags(votes, "reasons", "vote").unionByName(tags(reports, "criteria", "report"))
    return (
        rows.filter(F.col("reason").isin(CONCERNS))
        .groupBy("work_id", "reason")
        .agg(
            F.count("*").alias("total"), F.count_if(F.col("s") == "report").alias("reports"), F.count_if(F.col("s") == "vote").alias("upvotes")
        )
    )


def top_concerns(breakdown: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` most frequent concerns per work as text ``reason:total``; a work has at most five concerns."""
    ranked = breakdown.groupBy("work_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("minus"), "reason", "total"))).alias("__c"), F.sum("total").alias("signals")
    )
    shown = F.transform(F.slice("__c", 1, n), lambda c: F.concat(c["reason"], F.lit(":"), c["total"]))
    return ranked.select("work_id", "signals", F.array_join(shown, ", ").alias("top_concerns"))


def satisfaction_stats(reports: DataFrame, digits: int = 1) -> DataFrame:
    given = reports.filter("satisfaction is not null")
    return given.groupBy("work_id").agg(
        rounded(F.avg("satisfaction"), digits).alias("satisfaction_avg"), F.count("*").alias("satisfaction_count")
    )


def participation(counts: DataFrame) -> DataFrame:
    """min(40, votes) + min(60, 15 x reports), with its label."""
    score = F.least(F.lit(40), F.col("votes")) + F.least(F.lit(60), F.col("reports") * 15)
    label = F.when(score == 0, "NO_SIGNAL").when(score <= 25, "LOW").when(score <= 60, "MODERATE").otherwise("HIGH")
    return counts.withColumns({"psi_score": score.cast("long"), "label": label})


def distinct_citizens(votes: DataFrame, reports: DataFrame) -> DataFrame:
    """Citizens who voted on or reported a work, each once."""
    both = votes.select("work_id", "citizen_id").unionByName(reports.select("work_id", "citizen_id")).distinct()
    return both.groupBy("work_id").agg(F.count("*").alias("distinct_citizens"))


def engaged_works(votes: DataFrame, reports: DataFrame) -> DataFrame:
    return votes.select("work_id").unionByName(reports.select("work_id")).distinct()


def validate_reports(reports: DataFrame) -> DataFrame:
    """Reject reason per citizen report, null when it is valid; ``criteria`` is a comma-separated text."""
    listed = F.filter(F.transform(F.split(F.coalesce("criteria", F.lit("")), ","), lambda c: F.lower(F.trim(c))), lambda c: c != "")
    unknown = F.filter(listed, lambda c: ~c.isin(CONCERNS))
    rating = F.col("satisfaction")
    reason = (
        F.when(~rating.between(1, 5), "Satisfaction must be 1–5")
        .when((F.size(listed) == 0) & rating.isNull(), "Select at least one criteria OR give a satisfaction rating")
        .when(F.size(unknown) > 0, F.concat(F.lit("Unknown criteria: "), F.array_join(unknown, ", ")))
        .when(F.length("comment") > 2000, "Comment too long (max 2000 chars)")
    )
    return reports.withColumns({"reject_reason": reason, "valid": reason.isNull()})


def citizen_activity(votes: DataFrame, reports: DataFrame) -> DataFrame:
    v = votes.groupBy("citizen_id").agg(F.count("*").alias("upvotes_cast"))
    r = reports.groupBy("citizen_id").agg(F.count("*").alias("reports_filed"))
    zero = F.lit(0).cast("long")
    return v.join(r, "citizen_id", "full").select(
        "citizen_id", F.coalesce("upvotes_cast", zero).alias("upvotes_cast"), F.coalesce("reports_filed", zero).alias("reports_filed")
    )


def with_my_votes(works: DataFrame, votes: DataFrame, citizen_id: int) -> DataFrame:
    mine = votes.filter(F.col("citizen_id") == citizen_id).select("work_id", F.lit(True).alias("voted"))
    return works.join(mine, "work_id", "left").withColumn("voted", F.coalesce("voted", F.lit(False)))


def public_feed(
    works: DataFrame, votes: DataFrame, reports: DataFrame, order: str = "upvotes_desc", page: int = 1, size: int = 20,
    citizen_id: int | None = None, **filters,
) -> DataFrame:
    """One page of works with votes, reports, signals, top concerns, satisfaction and the citizen's own vote."""
    base = search(works.withColumn("project_id", F.col("work_id")), **filters).drop("project_id")
    counts = work_counts(votes, reports)
    concerns = top_concerns(concern_breakdown(votes, reports))
    joined = lookup_join(base, counts, "work_id", 0).join(concerns, "work_id", "left").join(satisfaction_stats(reports), "work_id", "left")
    joined = joined.withColumns({"signals": F.coalesce("signals", F.lit(0)), "top_concerns": F.coalesce("top_concerns", F.lit(""))})
    feed = page_of(joined, order_columns(order, "work_id"), page, size)
    return feed if citizen_id is None else with_my_votes(feed, votes, citizen_id)


def portal_overview(works: DataFrame, votes: DataFrame, reports: DataFrame) -> DataFrame:
    """Totals, the five most voted works, the six latest reports and engaged works by state, as (section, key, value)."""
    row = lambda df, section, key, value: df.select(F.lit(section).alias("section"), key.alias("key"), value.cast("long").alias("value"))
    engaged = engaged_works(votes, reports)
    citizens = votes.select("citizen_id").unionByName(reports.select("citizen_id")).distinct()
    count = lambda df, name: row(df.agg(F.count("*").alias("n")), "totals", F.lit(name), F.col("n"))
    totals = [count(citizens, "citizens"), count(votes, "upvotes"), count(reports, "reports"), count(engaged, "works_engaged")]
    ranked = votes.groupBy("work_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "work_id").limit(5)
    latest = reports.orderBy(F.desc("report_id")).limit(6)
    states = (
        works.join(engaged, "work_id", "left_semi").groupBy("state").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "state").limit(10)
    )
    parts = totals + [
        row(ranked, "top_upvoted", F.col("work_id"), F.col("n")),
        row(latest, "recent_reports", F.col("work_id"), F.col("report_id")),
        row(states, "by_state", F.col("state"), F.col("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- routed reports -------------------------------------------------------------------------------


def route_reports(created: DataFrame, works: DataFrame) -> DataFrame:
    """Inbox (type, key) of each report from its role and the work's place; ``reject_reason`` where there is none."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in TARGET_TYPES.items() for x in kv]), F.col("target_role"))
    named = lambda c: F.nullif(F.trim(c), F.lit(""))
    key = (
        F.when(kind == "mp", named("mp_name")).when(kind == "sno", named("state")).when(kind == "dm", named("constituency")).when(kind == "mospi", "*")
    )
    reason = (
        F.when(kind.isNull(), F.concat(F.lit("Unknown target_role: "), F.col("target_role")))
        .when(F.col("__known").isNull(), "Project not found")
        .when(key.isNull(), F.concat(F.lit("Work has no key for "), F.col("target_role")))
    )
    places = works.select("work_id", "mp_name", "state", "constituency", F.lit(True).alias("__known"))
    return (
        created.join(places, "work_id", "left")
        .withColumns({"target_type": kind, "target_key": key, "reject_reason": reason})
        .drop("mp_name", "state", "constituency", "__known")
    )


def report_states(actions: DataFrame) -> DataFrame:
    """Latest state per report from the action log: NEW, ACKNOWLEDGED; cleared reports disappear."""
    last = F.max_by("action", "action_id")
    created = F.col("action") == "CREATE"
    kept = actions.groupBy("report_id").agg(
        last.alias("__last"),
        F.max(F.when(F.col("action") == "ACK", F.col("action_id"))).alias("acknowledged_at"),
        F.max(F.when(created, F.col("action_id"))).alias("created_at"),
        *[F.max_by(F.when(created, F.col(c)), F.when(created, F.col("action_id"))).alias(c) for c in ("work_id", "target_role", "comment", "snapshot")],
    )
    alive = kept.filter(F.col("created_at").isNotNull() & (F.col("__last") != "CLEAR"))
    status = F.when(F.col("acknowledged_at") > F.col("created_at"), "ACKNOWLEDGED").otherwise("NEW")
    return alive.withColumn("status", status).drop("__last")


def inbox(routed: DataFrame, works: DataFrame, target_type: str, target_key: str, status: str | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """Newest reports of one inbox with the work's risk."""
    mine = routed.filter((F.col("target_type") == target_type) & (F.col("target_key") == target_key))
    if status:
        mine = mine.filter(F.col("status") == status.upper())
    shown = page_of(mine, [F.desc("report_id")], page, size)
    info = works.select("work_id", "mp_name", "state", F.rint(F.col("overall_risk_score") * 100).cast("long").alias("risk_score_display"), "risk_category")
    return shown.join(info, "work_id", "left")


def project_history(routed: DataFrame, works: DataFrame) -> DataFrame:
    """Every report of every work, with the work's totals; filter by work id."""
    totals = routed.groupBy("work_id").agg(F.count("*").alias("total_reports"), F.count_if(F.col("status") == "NEW").alias("new_reports"))
    info = works.select("work_id", "mp_name", "risk_category").join(totals, "work_id")
    events = routed.select(
        "work_id", "report_id", "target_role", "comment", F.col("snapshot").isNotNull().alias("has_snapshot"), "status", "created_at", "acknowledged_at"
    )
    return events.join(info, "work_id")

