"""Votes, citizen reports and routed reports."""

from pyspark.sql import functions as F

from ledgerlens.catalog.registry import R, cte, query
from ledgerlens.operators import civic

cte(
    "n_votes",
    "SELECT citizen_id, work_id, last(reasons ORDER BY action_id) reasons, max(action_id) action_id FROM r_votes GROUP BY 1,2 HAVING count(*)%2=1",
)
cte(
    "n_tags",
    "SELECT work_id, reason, count(*) total, count(*) FILTER (s='report') reports, count(*) FILTER (s='vote') upvotes FROM (SELECT work_id, unnest(reasons) reason, 'vote' s FROM n_votes UNION ALL SELECT work_id, unnest(criteria), 'report' FROM r_creports) WHERE reason IN ('stalled','quality','cost','ghost','other') GROUP BY 1,2",
)
cte(
    "n_counts",
    "SELECT work_id, coalesce(v,0) votes, coalesce(r,0) reports FROM (SELECT work_id, count(*) v FROM n_votes GROUP BY 1) FULL JOIN (SELECT work_id, count(*) r FROM r_creports GROUP BY 1) USING (work_id)",
)


def votes(t):
    return civic.current_votes(t.vote_actions)


@query("N01_current_votes", "SELECT citizen_id, work_id, CASE WHEN reasons IS NOT NULL THEN array_to_string(reasons,',') END reasons, action_id FROM n_votes")
def n01(t):
    return votes(t).withColumn("reasons", F.array_join(F.from_json("reasons", "array<string>"), ","))


@query("N02_work_counts", "SELECT * FROM n_counts")
def n02(t):
    return civic.work_counts(votes(t), t.citizen_reports)


@query("N03_concern_breakdown", "SELECT * FROM n_tags")
def n03(t):
    return civic.concern_breakdown(votes(t), t.citizen_reports)


@query("N04_satisfaction", f"SELECT work_id, {R('avg(satisfaction)', 1)} satisfaction_avg, count(*) satisfaction_count FROM r_creports WHERE satisfaction IS NOT NULL GROUP BY 1")
def n04(t):
    return civic.satisfaction_stats(t.citizen_reports)


@query(
    "N05_participation",
    "SELECT work_id, votes, reports, p psi_score, CASE WHEN p=0 THEN 'NO_SIGNAL' WHEN p<=25 THEN 'LOW' WHEN p<=60 THEN 'MODERATE' ELSE 'HIGH' END label FROM (SELECT *, least(40,votes)+least(60,reports*15) p FROM n_counts)",
)
def n05(t):
    return civic.participation(n02(t))


@query("N06_distinct_citizens", "SELECT work_id, count(DISTINCT citizen_id) distinct_citizens FROM (SELECT work_id, citizen_id FROM n_votes UNION ALL SELECT work_id, citizen_id FROM r_creports) GROUP BY 1")
def n06(t):
    return civic.distinct_citizens(votes(t), t.citizen_reports)


@query("O07_union_distinct", "SELECT work_id FROM n_votes UNION SELECT work_id FROM r_creports")
def o07(t):
    return civic.engaged_works(votes(t), t.citizen_reports)


@query(
    "N07_public_feed",
    f"""SELECT w.work_id, mp_name, coalesce(votes,0) votes, coalesce(reports,0) reports, coalesce(signals,0) signals, coalesce(top,'') top_concerns, sa satisfaction_avg, v.work_id IS NOT NULL voted
    FROM r_civic w LEFT JOIN n_counts USING (work_id) LEFT JOIN (SELECT work_id, sum(total)::BIGINT signals, array_to_string(list(reason||':'||total ORDER BY total DESC, reason)[1:3],', ') top FROM n_tags GROUP BY 1) USING (work_id)
    LEFT JOIN (SELECT work_id, {R("avg(satisfaction)", 1)} sa FROM r_creports WHERE satisfaction IS NOT NULL GROUP BY 1) USING (work_id) LEFT JOIN (SELECT work_id FROM n_votes WHERE citizen_id=7) v ON v.work_id=w.work_id
    WHERE contains(lower(state),'nation_1') ORDER BY coalesce(signals,0) DESC, overall_risk_score DESC, w.work_id LIMIT 20 OFFSET 20""",
)
def n07(t):
    feed = civic.public_feed(t.civic_works, votes(t), t.citizen_reports, "signals_desc", 2, 20, citizen_id=7, state="nation_1")
    return feed.select("work_id", "mp_name", "votes", "reports", "signals", "top_concerns", "satisfaction_avg", "voted")


@query(
    "N08_portal_overview",
    """SELECT 'totals' section, 'citizens' AS key, count(DISTINCT citizen_id) AS value FROM (SELECT citizen_id FROM n_votes UNION ALL SELECT citizen_id FROM r_creports) UNION ALL SELECT 'totals','upvotes',count(*) FROM n_votes
    UNION ALL SELECT 'totals','reports',count(*) FROM r_creports UNION ALL SELECT 'totals','works_engaged',count(*) FROM n_counts
    UNION ALL SELECT * FROM (SELECT 'top_upvoted', work_id, count(*) FROM n_votes GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5) UNION ALL SELECT * FROM (SELECT 'recent_reports', work_id, report_id FROM r_creports ORDER BY 3 DESC LIMIT 6)
    UNION ALL SELECT * FROM (SELECT 'by_state', state, count(*) FROM r_civic WHERE work_id IN (SELECT work_id FROM n_counts) GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""",
)
def n08(t):
    return civic.portal_overview(t.civic_works, votes(t), t.citizen_reports)


@query(
    "N09_report_validation",
    """SELECT report_id, reason IS NULL AS valid, reason reject_reason FROM (SELECT report_id, CASE WHEN satisfaction NOT BETWEEN 1 AND 5 THEN 'Satisfaction must be 1–5' WHEN len(c)=0 AND satisfaction IS NULL THEN
    'Select at least one criteria OR give a satisfaction rating' WHEN list_contains(c,'noise') THEN 'Unknown criteria: noise' WHEN report_id%19=0 THEN 'Comment too long (max 2000 chars)' END reason
    FROM (SELECT *, CASE WHEN report_id%5=0 THEN [] ELSE criteria END c FROM r_creports))""",
)
def n09(t):
    n = F.col("report_id")
    listed = F.when(n % 5 != 0, F.array_join(F.transform(F.from_json("criteria", "array<string>"), lambda c: F.concat(F.lit(" "), F.upper(c))), ","))
    comment = F.when(n % 19 == 0, F.repeat(F.lit("x"), 2001)).otherwise(F.col("comment"))
    return civic.validate_reports(t.citizen_reports.withColumns({"criteria": listed, "comment": comment})).select("report_id", "valid", "reject_reason")


@query(
    "N10_citizen_activity",
    "SELECT citizen_id, coalesce(v,0) upvotes_cast, coalesce(r,0) reports_filed FROM (SELECT citizen_id, count(*) v FROM n_votes GROUP BY 1) FULL JOIN (SELECT citizen_id, count(*) r FROM r_creports GROUP BY 1) USING (citizen_id)",
)
def n10(t):
    return civic.citizen_activity(votes(t), t.citizen_reports)


@query("N11_my_votes", "SELECT work_id, work_id IN (SELECT work_id FROM n_votes WHERE citizen_id=11) voted FROM r_civic")
def n11(t):
    return civic.with_my_votes(t.civic_works, votes(t), 11).select("work_id", "voted")


# --- routed reports -------------------------------------------------------------------------------

KIND = "CASE target_role WHEN 'MP' THEN 'mp' WHEN 'District Magistrate' THEN 'dm' WHEN 'State Nodal Officer' THEN 'sno' WHEN 'MoSPI Audit Cell' THEN 'mospi' END"
KEY = f"CASE {KIND} WHEN 'mp' THEN mp_name WHEN 'sno' THEN state WHEN 'dm' THEN constituency WHEN 'mospi' THEN '*' END"
cte(
    "b_state",
    """SELECT report_id, a acknowledged_at, c created_at, CASE WHEN a>c THEN 'ACKNOWLEDGED' ELSE 'NEW' END status, row.work_id, row.target_role, row.comment, row.snapshot FROM (SELECT report_id, last(action ORDER BY action_id) l,
    max(action_id) FILTER (action='ACK') a, max(action_id) FILTER (action='CREATE') c, last(struct_pack(work_id,target_role,comment,snapshot) ORDER BY action_id) FILTER (action='CREATE') row FROM r_actions GROUP BY 1) WHERE c IS NOT NULL AND l<>'CLEAR'""",
)
cte("b_routed", f"SELECT s.*, {KIND} target_type, {KEY} target_key FROM b_state s LEFT JOIN r_civic USING (work_id)")
COLUMNS = "report_id, work_id, target_role, target_type, target_key"


@query(
    "B01_route_reports",
    f"SELECT action_id, work_id, target_role, {KIND} target_type, CASE WHEN mp_name IS NOT NULL OR {KIND}='mospi' THEN {KEY} END target_key, CASE WHEN {KIND} IS NULL THEN 'Unknown target_role: '||target_role WHEN mp_name IS NULL THEN 'Project not found' END reject_reason FROM r_actions LEFT JOIN r_civic USING (work_id) WHERE action='CREATE'",
)
def b01(t):
    created = t.report_actions.filter("action = 'CREATE'")
    return civic.route_reports(created, t.civic_works).select("action_id", "work_id", "target_role", "target_type", "target_key", "reject_reason")


def routed(t):
    return civic.route_reports(civic.report_states(t.report_actions), t.civic_works)


@query(
    "B02_inbox",
    "SELECT report_id, work_id, status, mp_name, CAST(round_even(overall_risk_score*100,0) AS BIGINT) risk_score_display, risk_category FROM b_routed LEFT JOIN r_civic USING (work_id) WHERE target_type='mospi' AND status='NEW' ORDER BY report_id DESC LIMIT 50",
)
def b02(t):
    return civic.inbox(routed(t), t.civic_works, "mospi", "*", "new").select("report_id", "work_id", "status", "mp_name", "risk_score_display", "risk_category")


@query("B03_report_states", "SELECT report_id, work_id, target_role, status, created_at, acknowledged_at FROM b_state")
def b03(t):
    return civic.report_states(t.report_actions).select("report_id", "work_id", "target_role", "status", "created_at", "acknowledged_at")


@query(
    "B04_project_history",
    "SELECT work_id, report_id, snapshot IS NOT NULL has_snapshot, status, total_reports, new_reports, risk_category FROM b_routed JOIN (SELECT work_id, count(*) total_reports, count(*) FILTER (status='NEW') new_reports FROM b_routed GROUP BY 1) USING (work_id) JOIN r_civic USING (work_id)",
)
def b04(t):
    return civic.project_history(routed(t), t.civic_works).select("work_id", "report_id", "has_snapshot", "status", "total_reports", "new_reports", "risk_category")
