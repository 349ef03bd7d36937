"""Dashboard aggregates, searches, orders, pages and set operations."""

from pyspark.sql import functions as F

from ledgerlens.catalog.master import features_of, master_of
from ledgerlens.catalog.registry import R, query
from ledgerlens.functions.numbers import rounded
from ledgerlens.operators import agency, dashboard, master, ranking
from ledgerlens.operators.quality import union_all
from ledgerlens.operators.ranking import sequence_rank
from ledgerlens.sources.files import event_history

DEC = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"


@query(
    "A12_dashboard_summary",
    f"""SELECT *, {R("funds_utilized/funds_allocated*100", 1)} utilization_pct, {R("completed_works/CAST(total_works AS DOUBLE)*100", 1)} completion_pct,
    (SELECT {R("avg(expenditure_ratio*100)", 2)} FROM r_risk) avg_financial_progress FROM (SELECT count(*) total_works, count(DISTINCT mp_name) total_mps, {DEC.format("recommended_amount")} funds_allocated,
    {DEC.format("total_expenditure")} funds_utilized, sum(is_completed)::BIGINT completed_works FROM r_risk)""",
)
def a12(t):
    progress = t.risk.select((F.col("expenditure_ratio") * 100).alias("financial_progress_pct"))
    return dashboard.dashboard_summary(t.risk, progress)


@query(
    "A13_tier_distribution",
    f"SELECT risk_category, count(*) works, {R('count(*)/CAST((SELECT count(*) FROM r_risk) AS DOUBLE)*100', 2)} pct FROM r_risk GROUP BY 1",
)
def a13(t):
    return dashboard.tier_distribution(t.risk)


TIERS = ", ".join(f"count(*) FILTER (risk_category='{x}') {x.lower()}" for x in dashboard.TIERS)
FLAG = "risk_category IN ('HIGH','CRITICAL')"


@query(
    "A14_state_risk",
    f"""SELECT state, count(*) total_works, {TIERS}, count(*) FILTER ({FLAG}) high_critical, {DEC.format("recommended_amount")} funds_allocated, {DEC.format("total_expenditure")} funds_utilized,
    count(DISTINCT mp_name) FILTER ({FLAG}) flagged_mps FROM r_risk GROUP BY 1""",
)
def a14(t):
    return dashboard.state_risk(t.risk)


MP_SQL = f"""SELECT mp_name, min(state) state, min(constituency) constituency, count(*) works, count(*) FILTER ({FLAG}) flagged_count, {R("avg(overall_risk_score)", 9)} avg_score,
 max(overall_risk_score) max_score, {", ".join(f"count(*) FILTER (risk_category='{x}') {x.lower()}_count" for x in dashboard.TIERS)} FROM r_risk GROUP BY 1"""


def mps(t):
    return dashboard.mp_table(t.risk, t.mp_summary)


@query("A15_mp_table", f"SELECT m.*, house, allocated_amount, utilization_pct, completion_rate_pct FROM ({MP_SQL}) m LEFT JOIN r_mp USING (mp_name)")
def a15(t):
    out = mps(t).withColumn("avg_score", rounded(F.col("avg_score"), 9))
    kept = ["mp_name", "state", "constituency", "works", "flagged_count", "avg_score", "max_score"]
    return out.select(*kept, *[f"{x.lower()}_count" for x in dashboard.TIERS], "house", "allocated_amount", "utilization_pct", "completion_rate_pct")


SIGNAL_SQL = """SELECT signal, count(*) "count" FROM (SELECT trim(split_part(unnest(string_split(top_risk_signals,';')),'(',1)) signal FROM {0}) WHERE signal<>'' GROUP BY 1"""


@query("A16_signal_counts", SIGNAL_SQL.format("r_risk"))
def a16(t):
    return dashboard.signal_counts(t.risk)


@query(
    "A17_state_facets",
    f"""SELECT state, facet, f.value, works, flagged FROM (SELECT DISTINCT state, 'constituency' facet, constituency AS value FROM r_risk UNION SELECT DISTINCT state, 'mp', mp_name FROM r_risk) f
    JOIN (SELECT state, count(*) works, count(*) FILTER ({FLAG}) flagged FROM r_risk GROUP BY 1) USING (state)""",
)
def a17(t):
    return dashboard.state_facets(t.risk)


@query("A18_roster_totals", f"SELECT count(*) mps, sum(flagged_count)::BIGINT flagged, {DEC.format('allocated_amount')} allocated FROM ({MP_SQL}) JOIN r_mp USING (mp_name)")
def a18(t):
    return dashboard.roster_totals(mps(t))


@query("A19_scope_overview", f"SELECT count(*) works, sum(is_completed)::BIGINT completed, {TIERS} FROM r_risk WHERE contains(lower(state),'nation_1')")
def a19(t):
    return dashboard.scope_overview(t.risk, state="Nation_1")


@query(
    "A20_state_intensity",
    f"SELECT state, (4*critical+2*high+medium)/CAST(max(4*critical+2*high+medium) OVER () AS DOUBLE) intensity FROM (SELECT state, {TIERS} FROM r_risk GROUP BY 1)",
)
def a20(t):
    return dashboard.state_intensity(dashboard.state_risk(t.risk))


@query(
    "A21_run_metrics",
    f"""SELECT count(*) total_records, sum(payment_risk_flag::INT)::BIGINT anomaly_count, min(payment_risk_score) score_min, max(payment_risk_score) score_max,
    {R("quantile_cont(payment_risk_score,0.5)", 6)} score_median, {R("quantile_cont(payment_risk_score,0.9)", 6)} score_90th, {R("quantile_cont(payment_risk_score,0.95)", 6)} score_95th,
    {R("sum(payment_risk_flag::INT)/CAST(count(*) AS DOUBLE)*100", 2)} anomaly_percentage FROM r_risk""",
)
def a21(t):
    flagged = t.risk.withColumn("flag", F.col("payment_risk_flag").cast("int"))
    out = dashboard.run_metrics(flagged, "payment_risk_score", "flag")
    return out.withColumns({c: rounded(F.col(c), 6) for c in ("score_median", "score_90th", "score_95th")})


@query(
    "W06_top_in_row",
    """SELECT project_id, array_to_string(list_transform(list_sort(list_filter([struct_pack(m:=-cost_risk_score,n:='cost'),struct_pack(m:=-coalesce(delay_risk_score,-1),n:='delay'),
    struct_pack(m:=-payment_risk_score,n:='payment'),struct_pack(m:=-rule_risk_score,n:='rule'),struct_pack(m:=-iforest_risk_score,n:='iforest')],lambda x: x.m<=0))[1:3],lambda x: x.n),';') top FROM r_risk""",
)
def w06(t):
    scores = {e: F.when(F.col(f"{e}_available"), F.col(f"{e}_risk_score")) for e in ("cost", "delay", "payment", "rule", "iforest")}
    return t.risk.select("project_id", F.array_join(ranking.top_in_row(scores, 3), ";").alias("top"))


SHOWN = "project_id, mp_name, state, overall_risk_score, risk_category"
SHOWN_LIST = SHOWN.split(", ")


@query(
    "P01_project_search",
    f"""SELECT {SHOWN} FROM r_risk WHERE risk_category='HIGH' AND contains(lower(state),'nation_1') AND contains(lower(house),'a') AND contains(lower(coalesce(category,'')),'urgent')
    AND overall_risk_score>=0.65 AND (contains(lower(status),'completed') OR is_completed=1) AND (contains(lower(project_id),'lot 2') OR contains(lower(work_description),'lot 2'))""",
)
def p01(t):
    found = dashboard.search(t.risk, q="LOT 2", tier="high", state="Nation_1", house="A", category="Urgent", status="Completed", min_score=65)
    return found.select(*SHOWN_LIST)


ALERT_WHERE = "risk_category IN ('HIGH','CRITICAL') AND contains(lower(top_risk_signals),'delay') AND contains(lower(mp_name),'customer#0000001')"


def alert_rows(t):
    return dashboard.search(t.risk.filter(F.col("risk_category").isin(dashboard.FLAGGED)), signal="Delay", mp="Customer#0000001")


@query(
    "P02_alert_search",
    f"SELECT 'tier' section, risk_category AS key, count(*) \"count\" FROM r_risk WHERE {ALERT_WHERE} GROUP BY 2 UNION ALL SELECT 'signal', signal, \"count\" FROM ({SIGNAL_SQL.format('(SELECT * FROM r_risk WHERE ' + ALERT_WHERE + ')')})",
)
def p02(t):
    found = alert_rows(t)
    tiers = found.groupBy(F.col("risk_category").alias("key")).agg(F.count("*").alias("count")).select(F.lit("tier").alias("section"), "key", "count")
    signals = dashboard.signal_counts(found).select(F.lit("signal").alias("section"), F.col("signal").alias("key"), "count")
    return tiers.unionByName(signals)


@query("P03_mp_search", f"SELECT mp_name, works, flagged_count FROM ({MP_SQL}) JOIN r_mp USING (mp_name) WHERE contains(lower(mp_name),'#00000001') AND contains(lower(house),'asia')")
def p03(t):
    return dashboard.search(mps(t), mp="#00000001", house="Asia").select("mp_name", "works", "flagged_count")


def profiles(t):
    return agency.profile_vendors(master.build_vendor_features(t.payments))


@query(
    "P04_agency_search",
    "SELECT 'list' kind, agency_id, agency_risk_score FROM k_agency WHERE contains(lower(agency_name),'#00000001') UNION ALL SELECT 'detail', * FROM (SELECT agency_id, agency_risk_score FROM k_agency WHERE contains(lower(agency_id),'#00000002') ORDER BY agency_id LIMIT 1)",
)
def p04(t):
    p = profiles(t)
    listed = p.filter(dashboard.contains_ci(F.col("agency_name"), "#00000001"))
    columns = ["agency_id", "agency_risk_score"]
    return listed.select(F.lit("list").alias("kind"), *columns).unionByName(dashboard.find_agency(p, "#00000002").select(F.lit("detail").alias("kind"), *columns))


@query(
    "P06_compare_extremes",
    f"SELECT * FROM (SELECT {SHOWN} FROM r_risk WHERE risk_category='CRITICAL' ORDER BY overall_risk_score DESC, project_id LIMIT 2) UNION ALL SELECT * FROM (SELECT {SHOWN} FROM r_risk WHERE risk_category='LOW' ORDER BY overall_risk_score, project_id LIMIT 2)",
)
def p06(t):
    return dashboard.compare_extremes(t.risk).select(*SHOWN_LIST)


@query("O03_named_order", "SELECT mp_name, row_number() OVER (ORDER BY utilization_pct DESC NULLS LAST, mp_name) place FROM r_mp")
def o03(t):
    return sequence_rank(t.mp_summary.select("mp_name", "utilization_pct"), dashboard.order_columns("utilization_desc", "mp_name"), "place").select("mp_name", "place")


@query(
    "O04_pagination",
    f"SELECT {SHOWN}, (SELECT count(*) FROM r_risk) total, (SELECT CAST(ceil(count(*)/50e0) AS BIGINT) FROM r_risk) pages FROM r_risk ORDER BY overall_risk_score DESC, project_id LIMIT 50 OFFSET 100",
)
def o04(t):
    page = dashboard.page_of(t.risk, dashboard.order_columns("risk_desc", "project_id"), 3, 50).select(*SHOWN_LIST, F.lit(1).alias("one"))
    return page.join(dashboard.page_info(t.risk, 50).withColumn("one", F.lit(1)), "one").drop("one")


KEYSET = "SELECT project_id, overall_risk_score FROM (SELECT project_id, overall_risk_score, row_number() OVER (ORDER BY overall_risk_score {0} NULLS LAST, project_id) place FROM r_risk) WHERE place BETWEEN 101 AND 150"


@query("O04_keyset_page", KEYSET.format("DESC"))
def o04_keyset(t):
    """The third page by the values of the second one's last row."""
    order = dashboard.order_columns("risk_desc", "project_id")
    last = dashboard.page_of(t.risk, order, 2, 50).orderBy(F.asc("overall_risk_score"), F.desc("project_id")).first()
    return dashboard.page_after(t.risk, "risk_desc", "project_id", (last["overall_risk_score"], last["project_id"])).select("project_id", "overall_risk_score")


@query("O05_event_order", "SELECT event_id, seq, event_timestamp, row_number() OVER (ORDER BY event_timestamp, event_type, event_id, seq) place FROM r_events")
def o05(t):
    order = [F.asc(c) for c in ("event_timestamp", "event_type", "event_id", "seq")]
    return sequence_rank(t.project_events.select("event_id", "seq", "event_timestamp", "event_type"), order, "place").drop("event_type")


@query(
    "O06_union_kinds",
    "SELECT project_id, 'recommended' kind FROM r_works WHERE recommendation_date IS NOT NULL UNION ALL SELECT work_id, 'completed' FROM r_completions UNION ALL SELECT vendor, 'paid' FROM r_payments",
)
def o06(t):
    return union_all(
        [
            t.works.filter("recommendation_date is not null").select("project_id", F.lit("recommended").alias("kind")),
            t.completions.select(F.col("work_id").alias("project_id"), F.lit("completed").alias("kind")),
            t.payments.select(F.col("vendor").alias("project_id"), F.lit("paid").alias("kind")),
        ]
    )


@query(
    "J10_display_fields",
    "SELECT project_id, overall_risk_score, CAST(round_even(overall_risk_score*100,0) AS BIGINT) risk_score_display, w.work_description, w.house FROM r_risk r JOIN r_works w USING (project_id)",
)
def j10(t):
    thin = t.risk.select("project_id", "overall_risk_score", "status")
    return dashboard.with_display(thin, t.works).select("project_id", "overall_risk_score", "risk_score_display", "work_description", "house")


@query(
    "J11_dossier",
    "SELECT r.project_id, r.risk_category, CAST(round_even(overall_risk_score*100,0) AS BIGINT) risk_score_display, investigation_priority_score, investigation_urgency, m.status, m.primary_vendor, m.payment_count, f.peer_median_cost, f.cost_variation_pct, f.days_since_recommendation FROM r_risk r JOIN k_prio USING (project_id) LEFT JOIN k_master m USING (project_id) LEFT JOIN k_feat f USING (project_id)",
)
def j11(t):
    return dashboard.dossier(t.risk, master_of(t), features_of(t)).select(
        "project_id", "risk_category", "risk_score_display", "investigation_priority_score", "investigation_urgency", "status", "primary_vendor",
        "payment_count", "peer_median_cost", "cost_variation_pct", "days_since_recommendation",
    )


@query("P07_event_history", "SELECT event_id, seq FROM r_events WHERE event_type='PAYMENT_RECEIVED' AND lower(state)='state 1' AND event_timestamp BETWEEN '2024-01-05' AND '2024-01-20'")
def p07(t):
    events = event_history(t.project_events, event_type="PAYMENT_RECEIVED")
    window = F.col("event_timestamp").between("2024-01-05", "2024-01-20")
    return events.filter((F.lower("state") == "state 1") & window).select("event_id", "seq")
