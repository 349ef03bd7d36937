"""Rule engine: single rules on records with every field, then the dataset run on project features."""

from pyspark.sql import functions as F

from ledgerlens.catalog.master import features_of
from ledgerlens.catalog.registry import R, cte, query
from ledgerlens.functions.numbers import rounded
from ledgerlens.operators import ranking, rules
from ledgerlens.session import materialize
from ledgerlens.sources.testtables import AS_OF


def now():
    return F.lit(AS_OF).cast("date")


def records(t):
    """Orders as project records with missing, blank and out-of-range fields; dates are text in two formats."""
    n, price, start = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderdate").cast("date")
    day = lambda d: F.when(n % 2 == 0, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    shift = lambda days: F.date_add(start, days.cast("int"))
    status = ["ongoing", "Completed", " cancelled ", "Unknown", "", None, "in progress", "started"]
    return t.read("orders").select(
        F.concat(F.lit("P"), n).alias("project_id"),
        F.when(n % 7 == 1, "  ").when(n % 7 > 1, F.concat(F.lit("Work "), n)).alias("project_name"),
        F.when(n % 31 != 0, F.when(n % 29 == 0, -price).otherwise(price)).alias("sanctioned_amount"),
        F.when(n % 6 != 0, day(start)).alias("start_date"),
        F.element_at(F.array(*map(F.lit, status)), (n % 8 + 1).cast("int")).alias("status"),
        F.when(n % 10 == 0, "").otherwise(F.concat(F.lit("Area "), n % 5)).alias("location"),
        F.when(n % 4 != 0, "Agency").alias("implementing_agency"),
        F.when(n % 9 != 0, (n % 130) - 10 + 0.5 * (n % 2)).alias("progress_percentage"),
        F.when(n % 37 != 0, rounded(price * (n % 150) / 100.0, 2)).alias("actual_expenditure"),
        F.when(n % 5 != 0, rounded(price * (n * 3 % 150) / 100.0, 2)).alias("total_payments"),
        rounded(price * 0.1, 2).alias("payment_amount"),
        F.when(n % 41 == 0, -5.0).otherwise(5.0).alias("released_amount"),
        F.when(n % 3 != 0, day(shift(n % 400 - 50))).alias("completion_date"),
        F.when(n % 17 != 0, day(shift(n % 900 - 60))).alias("expected_completion_date"),
        F.when(n % 2 != 0, day(shift(n % 500 - 20))).alias("last_progress_update"),
    )


cte(
    "k_rec",
    f"""SELECT *, lower(trim(coalesce(status,''))) st,
    CASE WHEN coalesce(last_progress_update,start_date) IS NOT NULL THEN greatest(0,date_diff('day',coalesce(last_progress_update,start_date),DATE '{AS_OF}')) END idle,
    CASE WHEN plan<=0 THEN CASE WHEN gone>=0 THEN 100e0 ELSE 0e0 END WHEN plan>0 THEN {R("greatest(0e0,gone/CAST(plan AS DOUBLE)*100)", 2)} END share
    FROM (SELECT *, date_diff('day',start_date,expected_completion_date) plan, date_diff('day',start_date,DATE '{AS_OF}') gone FROM (
    SELECT 'P'||n project_id, CASE WHEN n%7=1 THEN '  ' WHEN n%7>1 THEN 'Work '||n END project_name,
    CASE WHEN n%31<>0 THEN CASE WHEN n%29=0 THEN -price ELSE price END END sanctioned_amount,
    CASE WHEN n%6<>0 THEN d END start_date,
    ['ongoing','Completed',' cancelled ','Unknown','',NULL,'in progress','started'][n%8+1] status,
    CASE WHEN n%10=0 THEN '' ELSE 'Area '||(n%5) END location, CASE WHEN n%4<>0 THEN 'Agency' END implementing_agency,
    CASE WHEN n%9<>0 THEN (n%130)-10+0.5e0*(n%2) END done,
    CASE WHEN n%37<>0 THEN {R("price*(n%150)/100e0", 2)} END spent,
    CASE WHEN n%5<>0 THEN {R("price*(n*3%150)/100e0", 2)} END total_payments, {R("price*0.1e0", 2)} payment_amount,
    CASE WHEN n%41=0 THEN -5e0 ELSE 5e0 END released_amount,
    CASE WHEN n%3<>0 THEN d+CAST(n%400-50 AS INT) END completion_date,
    CASE WHEN n%17<>0 THEN d+CAST(n%900-60 AS INT) END expected_completion_date,
    CASE WHEN n%2<>0 THEN d+CAST(n%500-20 AS INT) END last_progress_update
    FROM (SELECT o_orderkey n, o_totalprice price, CAST(o_orderdate AS DATE) d FROM orders)))""",
)
M = "format('{:,.2f}',{0})"
SCORE = "CASE WHEN fired THEN CASE sev WHEN 'LOW' THEN 20 WHEN 'MEDIUM' THEN 40 WHEN 'HIGH' THEN 70 ELSE 90 END ELSE 0 END::BIGINT score"


def m(x):
    return "format('{:,.2f}'," + x + ")"


def rule_sql(trigger, severity, message, extra=""):
    return f"""SELECT project_id, fired triggered, CASE WHEN fired THEN sev ELSE 'LOW' END severity, {SCORE}, msg AS message{extra} FROM
    (SELECT *, coalesce({trigger},false) fired, {severity} sev, {message} msg FROM k_rec)"""


def show(t, rule):
    ready, payload = rules.prepare(records(t), now())
    return ready.select("project_id", rule(payload).alias("r")).select("project_id", "r.triggered", "r.severity", "r.score", "r.message")


MISSING = "list_filter([" + ",".join(
    f"CASE WHEN coalesce(trim(CAST({c} AS VARCHAR)),'')='' THEN '{c}' END" for c in rules.CRITICAL_FIELDS
) + "], lambda x: x IS NOT NULL)"


@query(
    "R00_rule_result",
    "SELECT project_id, 'X-1' rule_id, overall_risk_score>0.9 triggered, CASE WHEN overall_risk_score>0.9 THEN 'CRITICAL' ELSE 'LOW' END severity,"
    " CASE WHEN overall_risk_score>0.9 THEN 90 ELSE 0 END::BIGINT score, 'state '||state AS message, '{\"state\":\"'||state||'\"}' evidence FROM r_risk",
)
def r00(t):
    result = rules.rule_result(
        "X-1", "Very high score", "DEMO", F.col("overall_risk_score") > 0.9, "CRITICAL",
        rules.text("state ", F.col("state")), {"state": F.col("state")},
    )
    out = t.risk.select("project_id", result.alias("r"))
    return out.select("project_id", "r.rule_id", "r.triggered", "r.severity", "r.score", "r.message", "r.evidence")


SQL = {}
SQL["COMPLIANCE-001"] = rule_sql(
    f"len({MISSING})>0", f"CASE WHEN len({MISSING})>1 THEN 'HIGH' ELSE 'MEDIUM' END",
    f"CASE WHEN len({MISSING})>0 THEN 'Project record is missing '||len({MISSING})||' critical field(s): '||array_to_string({MISSING},', ')||'.' ELSE 'All critical project fields are present.' END",
)
SQL["COMPLIANCE-002"] = rule_sql(
    f"st='' OR st NOT IN {tuple(rules.ALLOWED_STATUSES)}", "'MEDIUM'",
    f"CASE WHEN st='' THEN 'Project status is missing or empty.' WHEN st NOT IN {tuple(rules.ALLOWED_STATUSES)} THEN "
    "'Project status '''||status||''' is not recognized among valid status values.' ELSE 'Project status '''||status||''' is valid.' END",
)
SQL["COMPLIANCE-003"] = rule_sql(
    "done<0 OR done>100", "'HIGH'",
    "CASE WHEN done IS NULL THEN 'Progress percentage is not provided or unparseable; not evaluated.' WHEN done<0 OR done>100 THEN "
    "'Reported progress percentage ('||done||'%) is out of valid bounds [0.0, 100.0].' ELSE 'Reported progress percentage ('||done||'%) is within valid bounds.' END",
)
NEG = "list_filter([" + ",".join(
    f"CASE WHEN {c}<0 THEN '{n}='||{c} END"
    for n, c in (("sanctioned_amount", "sanctioned_amount"), ("actual_expenditure", "spent"), ("payment_amount", "payment_amount"),
                 ("total_payments", "total_payments"), ("released_amount", "released_amount"))
) + "], lambda x: x IS NOT NULL)"
SQL["COMPLIANCE-004"] = rule_sql(
    f"len({NEG})>0", "'HIGH'",
    f"CASE WHEN len({NEG})>0 THEN 'Found negative financial value(s): '||array_to_string({NEG},', ')||'.' ELSE 'All checked financial values are non-negative.' END",
)
EARLY = "list_filter([" + ",".join(
    f"CASE WHEN {c}<start_date THEN '{label} ('||{c}||') is earlier than start date ('||start_date||')' END"
    for c, label in (("completion_date", "Actual completion date"), ("expected_completion_date", "Expected completion date"),
                     ("last_progress_update", "Last progress update date"))
) + "], lambda x: x IS NOT NULL)"
SQL["COMPLIANCE-005"] = rule_sql(
    f"len({EARLY})>0", "'HIGH'",
    f"CASE WHEN len({EARLY})>0 THEN 'Chronological inconsistency in project dates: '||array_to_string({EARLY},'; ')||'.' ELSE 'Project milestone dates are chronologically consistent.' END",
)
NOT_DONE = "'Project status is '''||coalesce(status,'None')||''', not ''completed''. Rule not triggered.'"
SQL["COMPLIANCE-006"] = rule_sql(
    "st='completed' AND (done IS NULL OR done<100)", "CASE WHEN done IS NULL THEN 'MEDIUM' ELSE 'HIGH' END",
    f"CASE WHEN st<>'completed' THEN {NOT_DONE} WHEN done IS NULL THEN 'Project is marked completed, but progress percentage is missing.' WHEN done<100 THEN "
    "'Project is marked ''completed'' but reported progress is only '||done||'% (expected 100%).' ELSE 'Project is marked ''completed'' and reports 100% progress.' END",
)
SQL["COMPLIANCE-007"] = rule_sql(
    "st='completed' AND completion_date IS NULL", "'MEDIUM'",
    f"CASE WHEN st<>'completed' THEN {NOT_DONE} WHEN completion_date IS NULL THEN 'Project is marked ''completed'' but no valid completion date is recorded.' "
    "ELSE 'Project is marked ''completed'' with recorded completion date '||completion_date||'.' END",
)
PAID = "coalesce(total_payments,payment_amount)"
EXCESS = R(f"{PAID}-spent", 2)
SQL["COMPLIANCE-008"] = rule_sql(
    f"{EXCESS}>0.01", "'HIGH'",
    f"CASE WHEN spent IS NULL THEN 'Insufficient expenditure or payment data to evaluate consistency.' WHEN {EXCESS}>0.01 THEN "
    f"'Total payments (INR '||{m(PAID)}||') exceed reported actual expenditure (INR '||{m('spent')}||') by INR '||{m(EXCESS)}||'.' "
    f"ELSE 'Payments (INR '||{m(PAID)}||') are within reported actual expenditure (INR '||{m('spent')}||').' END",
)
SQL["GHOST-001"] = rule_sql(
    "done<=5 AND idle>=120", "'HIGH'",
    "CASE WHEN done IS NULL THEN 'Progress percentage is missing; unable to evaluate no-progress rule.' WHEN idle IS NULL THEN "
    "'Reference date (last update or start date) is missing; unable to calculate duration.' WHEN done<=5 AND idle>=120 THEN "
    "'Project has shown no meaningful progress ('||done||'%) for '||idle||' days (threshold: 120 days).' ELSE "
    "'Project progress activity is within normal expectations ('||done||'% progress, '||idle||' days since update).' END",
)
RATIO = "spent/sanctioned_amount"
PCT = R(f"{RATIO}*100", 2)
SQL["GHOST-002"] = rule_sql(
    f"{RATIO}>=0.5 AND done<=20", f"CASE WHEN {RATIO}>=0.75 AND done<=15 THEN 'CRITICAL' ELSE 'HIGH' END",
    f"CASE WHEN {RATIO} IS NULL OR done IS NULL THEN 'Insufficient expenditure, sanctioned budget, or progress data to evaluate mismatch.' WHEN {RATIO}>=0.5 AND done<=20 THEN "
    f"'High expenditure with comparatively low reported progress: INR '||{m('spent')}||' spent ('||{PCT}||'% of sanctioned INR '||{m('sanctioned_amount')}||') with only '||done||'% physical progress completed.' "
    f"ELSE 'Expenditure and progress relationship is within expected tolerance ('||{PCT}||'% budget spent, '||done||'% progress).' END",
)
ACTIVE = f"st IN {tuple(rules.ACTIVE_STATUSES)}"
SQL["GHOST-003"] = rule_sql(
    f"{ACTIVE} AND idle>=90", "CASE WHEN idle>=180 THEN 'HIGH' ELSE 'MEDIUM' END",
    f"CASE WHEN NOT {ACTIVE} THEN 'Project status is '''||coalesce(status,'None')||''', not in active/ongoing states. Rule not triggered.' WHEN idle IS NULL THEN "
    "'Active project is missing update and start dates; cannot measure inactivity period.' WHEN idle>=90 THEN "
    "'Project is marked as '''||status||''' but has had no reported progress or updates for '||idle||' days (inactivity threshold: 90 days).' "
    "ELSE 'Active project has recent activity ('||idle||' days since update, within threshold of 90 days).' END",
)
FIRE4 = "done<=20 AND coalesce(idle,0)>=90 AND share>=50"
SQL["GHOST-004"] = rule_sql(
    FIRE4, "'CRITICAL'",
    f"CASE WHEN done IS NULL OR share IS NULL THEN 'Insufficient data (progress, start date, or completion date missing) to evaluate composite stall indicator.' WHEN {FIRE4} THEN "
    "'Strong stalled-project indicator: Project has low progress ('||done||'%), has been inactive for '||coalesce(idle,0)||' days, and has consumed '||share||'% of planned schedule.' "
    "ELSE 'Composite stalled indicator not met (progress: '||done||'%, inactive: '||coalesce(idle,0)||'d, elapsed schedule: '||share||'%).' END",
)
EXPECTED = "least(100e0,share)"
EXPECTED = f"(CASE WHEN share IS NOT NULL THEN {EXPECTED} END)"
SQL["PROGRESS-001"] = rule_sql(
    "false", "'LOW'",
    f"CASE WHEN share IS NULL THEN 'Cannot calculate expected progress due to missing start or expected completion date.' ELSE 'Calculated expected progress is '||{EXPECTED}||'% based on elapsed timeline.' END",
)
GAP = R(f"{EXPECTED}-done", 2)
SQL["PROGRESS-003"] = rule_sql(
    f"{GAP}>=15", f"CASE WHEN {GAP}>=70 THEN 'CRITICAL' WHEN {GAP}>=50 THEN 'HIGH' WHEN {GAP}>=30 THEN 'MEDIUM' ELSE 'LOW' END",
    f"CASE WHEN {GAP} IS NULL THEN 'Insufficient data to compute progress gap.' "
    f"WHEN {GAP}>=70 THEN 'Critical progress gap: actual progress ('||done||'%) lags expected progress ('||{EXPECTED}||'%) by '||{GAP}||' percentage points.' "
    f"WHEN {GAP}>=50 THEN 'High progress gap: actual progress ('||done||'%) is substantially below expected progress ('||{EXPECTED}||'%) by '||{GAP}||' percentage points.' "
    f"WHEN {GAP}>=30 THEN 'Moderate progress gap: actual progress ('||done||'%) lags expected progress ('||{EXPECTED}||'%) by '||{GAP}||' percentage points.' "
    f"WHEN {GAP}>=15 THEN 'Minor progress gap: actual progress ('||done||'%) is '||{GAP}||' percentage points behind expected progress ('||{EXPECTED}||'%).' "
    f"WHEN {GAP}<0 THEN 'Project is ahead of schedule by '||abs({GAP})||' percentage points (actual: '||done||'%, expected: '||{EXPECTED}||'%).' "
    f"ELSE 'Progress gap is within acceptable limits ('||{GAP}||' percentage points; actual: '||done||'%, expected: '||{EXPECTED}||'%).' END",
)
SQL["PROGRESS-004"] = rule_sql(
    "share>=75 AND done<=25", "CASE WHEN share>=90 AND done<=15 THEN 'CRITICAL' ELSE 'HIGH' END",
    "CASE WHEN share IS NULL OR done IS NULL THEN 'Insufficient date or progress data to evaluate progress/duration mismatch.' WHEN share>=75 AND done<=25 THEN "
    "'High duration/progress mismatch: '||share||'% of project schedule has elapsed, but only '||done||'% physical progress has been reported.' "
    "ELSE 'Progress duration alignment is acceptable ('||share||'% elapsed, '||done||'% completed).' END",
)

SINGLE = {
    "R01_missing_critical_fields": ("COMPLIANCE-001", lambda q: rules.missing_critical_fields(q)),
    "R02_invalid_status": ("COMPLIANCE-002", lambda q: rules.invalid_status(q)),
    "R03_invalid_progress": ("COMPLIANCE-003", lambda q: rules.invalid_progress(q)),
    "R04_negative_financials": ("COMPLIANCE-004", lambda q: rules.negative_financials(q)),
    "R05_invalid_dates": ("COMPLIANCE-005", lambda q: rules.invalid_dates(q)),
    "R06_completed_progress_mismatch": ("COMPLIANCE-006", lambda q: rules.completed_progress_mismatch(q)),
    "R07_completed_without_date": ("COMPLIANCE-007", lambda q: rules.completed_without_date(q)),
    "R08_payment_inconsistency": ("COMPLIANCE-008", lambda q: rules.payment_inconsistency(q)),
    "R09_no_progress": ("GHOST-001", lambda q: rules.no_progress(q, now())),
    "R10_spend_progress_mismatch": ("GHOST-002", lambda q: rules.spend_progress_mismatch(q)),
    "R11_active_inactivity": ("GHOST-003", lambda q: rules.active_inactivity(q, now())),
    "R12_stalled_composite": ("GHOST-004", lambda q: rules.stalled_composite(q, now())),
    "R13_expected_progress": ("PROGRESS-001", lambda q: rules.expected_progress_rule(q, now())),
    "R15_significant_gap": (
        "PROGRESS-003",
        lambda q: rules.significant_gap(q, now()),
    ),
    "R16_duration_mismatch": ("PROGRESS-004", lambda q: rules.duration_mismatch(q, now())),
}
for _name, (_id, _rule) in SINGLE.items():
    query(_name, SQL[_id])(lambda t, rule=_rule: show(t, rule))


@query("R14_progress_gap", f"SELECT project_id, {EXPECTED} expected, {GAP} gap FROM k_rec")
def r14(t):
    ready, q = rules.prepare(records(t), now())
    return ready.select("project_id", rules.expected_progress(q, now()).alias("expected"), q["__gap"].alias("gap"))


@query(
    "R17_rule_suites",
    " UNION ALL ".join(f"SELECT '{i}' rule_id, project_id, triggered, severity, score FROM ({SQL[i]})" for i in SQL),
)
def r17(t):
    found = rules.evaluate_records(records(t), AS_OF).select("project_id", F.inline("findings"))
    return found.select("rule_id", "project_id", "triggered", "severity", "score")


# --- dataset run ----------------------------------------------------------------------------------

OVER = R("(expenditure_ratio-1)*100", 2)
MISS = "CASE WHEN recommended_amount IS NULL THEN 3 ELSE 2 END"
DATASET = [
    ("COMPLIANCE-001", "Missing critical project information", "true", "'HIGH'",
     f"'Project record is missing '||{MISS}||' critical field(s): '||CASE WHEN recommended_amount IS NULL THEN 'sanctioned_amount, ' ELSE '' END||'start_date, implementing_agency.'"),
    ("COMPLIANCE-002", "Invalid project status", "false", "'MEDIUM'", "''"),
    ("COMPLIANCE-003", "Invalid progress percentage", "false", "'HIGH'", "''"),
    ("COMPLIANCE-004", "Negative financial values", "total_expenditure<0 OR recommended_amount<0", "'HIGH'", "''"),
    ("COMPLIANCE-005", "Invalid dates chronology", "recommendation_to_completion_days<0", "'HIGH'",
     "'Chronological error: Recorded completion date preceded recommendation date by '||abs(recommendation_to_completion_days)||' days.'"),
    ("COMPLIANCE-006", "Completed project with progress below 100%", "is_completed=1", "'MEDIUM'",
     "'Project is marked completed, but progress percentage is missing.'"),
    ("COMPLIANCE-007", "Completed project with missing completion date", "is_completed=1 AND recommendation_to_completion_days IS NULL", "'MEDIUM'",
     "'Project is marked ''completed'' but completion interval data is missing.'"),
    ("COMPLIANCE-008", "Payment/expenditure inconsistency", f"{R('coalesce(payment_count*average_payment,total_expenditure)-total_expenditure', 2)}>0.01", "'HIGH'", "''"),
    ("GHOST-001", "No-progress detection", "false", "'HIGH'", "''"),
    ("GHOST-002", "Expenditure-progress mismatch", "expenditure_ratio>1 AND recommended_amount>0", "CASE WHEN expenditure_ratio>=1.5 THEN 'CRITICAL' ELSE 'HIGH' END",
     f"'High expenditure relative to budget: INR '||{m('total_expenditure')}||' spent exceeds sanctioned amount (INR '||{m('recommended_amount')}||') by '||{OVER}||'% (expenditure_ratio='||{R('expenditure_ratio', 4)}||').'"),
    ("GHOST-003", "Active project with no recent activity", "is_completed=0 AND days_since_recommendation>=90", "CASE WHEN days_since_recommendation>=180 THEN 'HIGH' ELSE 'MEDIUM' END",
     "'Project is marked as ''ongoing'' but has had no completion or update for '||days_since_recommendation||' days (inactivity threshold: 90 days).'"),
    ("GHOST-004", "Stalled project composite indicator", "false", "'CRITICAL'", "''"),
    ("PROGRESS-001", "Expected progress estimation", "false", "'LOW'", "''"),
    ("PROGRESS-003", "Significant progress gap", "false", "'LOW'", "''"),
    ("PROGRESS-004", "Progress and duration mismatch", "false", "'HIGH'", "''"),
]
cte(
    "k_rules",
    "SELECT project_id, i.id rule_id, i.n rule_name, i.t triggered, CASE WHEN i.t THEN i.s ELSE 'LOW' END severity, "
    "CASE WHEN i.t THEN CASE i.s WHEN 'LOW' THEN 20 WHEN 'MEDIUM' THEN 40 WHEN 'HIGH' THEN 70 ELSE 90 END ELSE 0 END::BIGINT score, i.m reason "
    "FROM (SELECT project_id, unnest(["
    + ",".join(f"struct_pack(id:='{i}',n:='{n}',t:=coalesce({c},false),s:={s},m:={msg})" for i, n, c, s, msg in DATASET)
    + "]) i FROM k_feat)",
)
cte(
    "k_roll",
    """SELECT project_id, sum(score)::BIGINT rule_risk_score, count(*) rule_count, string_agg(rule_id,';' ORDER BY rule_id) rules_triggered,
    array_to_string(list(reason ORDER BY rule_id)[1:3],' | ') top_reasons,
    CASE WHEN bool_or(severity='CRITICAL') OR sum(score)>=120 THEN 'CRITICAL_RISK' WHEN bool_or(severity='HIGH') OR sum(score)>=70 THEN 'HIGH_RISK'
    WHEN bool_or(severity='MEDIUM') OR sum(score)>=40 THEN 'MEDIUM_RISK' ELSE 'LOW_RISK' END risk_band FROM k_rules WHERE triggered GROUP BY 1""",
)


def evaluated(t, triggered_only=False):
    return rules.evaluate_features(features_of(t), triggered_only)


def rollup_of(t):
    return rules.project_rollup(evaluated(t, triggered_only=True))


@query("R18_dataset_rules", "SELECT project_id, rule_id, triggered, severity, score FROM k_rules")
def r18(t):
    return evaluated(t).select("project_id", F.inline("findings")).select("project_id", "rule_id", "triggered", "severity", "score")


@query(
    "R19_verification_input",
    """SELECT project_id, rule_risk_score, risk_band, rules_triggered, rule_count, top_reasons, mp_name, recommended_amount, expenditure_ratio, peer_median_cost,
    coalesce(CASE WHEN payment_count>4 THEN 0.5e0 END,0) similarity_anomaly_score, CASE WHEN payment_count>4 THEN 'MEDIUM_SIMILARITY' ELSE 'UNIQUE' END similarity_risk_band
    FROM k_roll JOIN k_feat USING (project_id)""",
)
def r19(t):
    # the handoff and the similarity result are cut from the same projects
    roll = materialize(rollup_of(t), "rollup")
    # works with few payments have their result under another id, so they find none
    other = F.when(F.col("payment_count") > 4, F.col("project_id")).otherwise(F.concat("project_id", F.lit("|other")))
    similarity = roll.select(other.alias("project_id"), F.lit(0.5).alias("similarity_anomaly_score"), F.lit("MEDIUM_SIMILARITY").alias("similarity_risk_band"))
    return rules.verification_input(roll, similarity).select(
        "project_id", *rules.ROLLUP, "mp_name", "recommended_amount", "expenditure_ratio", "peer_median_cost",
        "similarity_anomaly_score", "similarity_risk_band",
    )


@query(
    "A05_rule_event_aggregate",
    """SELECT project_id, count(*) rule_event_count, CASE max(o) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END max_rule_severity,
    max(CASE o WHEN 4 THEN 75e0 WHEN 3 THEN 50e0 WHEN 2 THEN 25e0 ELSE 10e0 END) max_rule_severity_score,
    string_agg(rule_id,'; ' ORDER BY o DESC, rule_id) rule_ids_triggered, string_agg(reason,'; ' ORDER BY o DESC, rule_id) rule_reasons_summary
    FROM (SELECT *, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END o FROM k_rules WHERE triggered) GROUP BY 1""",
)
def a05(t):
    return rules.aggregate_rule_events(rules.rule_events(evaluated(t, triggered_only=True)))


@query(
    "A06_rule_summary",
    f"""SELECT rule_id, rule_name, count(*) projects_checked, count(*) FILTER (triggered) projects_triggered,
    {",".join(f"count(*) FILTER (triggered AND severity='{s}') {s.lower()}_count" for s in ("LOW", "MEDIUM", "HIGH", "CRITICAL"))},
    {R("count(*) FILTER (triggered)/CAST(count(*) AS DOUBLE)*100", 2)} trigger_rate FROM k_rules GROUP BY 1,2""",
)
def a06(t):
    return rules.rule_summary(evaluated(t))


@query("A07_project_rollup", "SELECT project_id, rule_risk_score, risk_band, rules_triggered, rule_count, top_reasons FROM k_roll")
def a07(t):
    return rules.flagged_projects(rollup_of(t))


@query("A08_band_histogram", "SELECT risk_band, count(*) projects FROM k_roll GROUP BY 1")
def a08(t):
    return rules.band_histogram(rollup_of(t))


@query(
    "P05_rule_event_filter",
    "SELECT project_id, rule_id, rule_name, severity, score, reason FROM k_rules WHERE triggered AND severity='CRITICAL' AND rule_id='GHOST-002'",
)
def p05(t):
    found = rules.filter_events(rules.rule_events(evaluated(t, triggered_only=True)), rule_id="GHOST-002", severity="critical")
    return found.select("project_id", "rule_id", "rule_name", "severity", "score", "reason")


@query(
    "O01_flagged_order",
    "SELECT project_id, rule_risk_score, rule_count, row_number() OVER (ORDER BY rule_risk_score DESC, rule_count DESC, project_id) place FROM k_roll",
)
def o01(t):
    order = [F.desc("rule_risk_score"), F.desc("rule_count"), F.asc("project_id")]
    return ranking.sequence_rank(rules.flagged_projects(rollup_of(t)).select("project_id", "rule_risk_score", "rule_count"), order, "place")


@query(
    "O02_top_cases",
    """SELECT project_id, rule_risk_score, risk_band, rules_triggered, rule_count, top_reasons FROM k_roll
    ORDER BY rule_risk_score DESC, rule_count DESC, project_id LIMIT 100""",
)
def o02(t):
    order = [F.desc("rule_risk_score"), F.desc("rule_count"), F.asc("project_id")]
    return ranking.top_rows(rules.flagged_projects(rollup_of(t)), order, 100)
