"""Event log queries: batch routing and folds with check SQL, and the streaming jobs."""

from pyspark.sql import functions as F

from ledgerlens.catalog.master import master_of
from ledgerlens.catalog.registry import cte, query
from ledgerlens.session import scratch_path
from ledgerlens.sources.testtables import Tables
from ledgerlens.streaming import events, jobs

STATUS = "CASE WHEN trim(payment_status)='' THEN NULL WHEN lower(trim(payment_status))='payment success' THEN 'successful' WHEN lower(trim(payment_status))='payment in-progress' THEN 'payment_in_progress' ELSE lower(trim(payment_status)) END"
cte(
    "l_gate",
    f"""SELECT *, CASE WHEN mapping_status IN ('unresolved','ambiguous') THEN 'skipped' WHEN reason IS NOT NULL THEN 'invalid' ELSE 'processed' END gate FROM (SELECT * EXCLUDE (payment_status), {STATUS} payment_status,
    CASE WHEN mp_name IS NULL THEN 'missing required field' WHEN event_source='unknown_feed' THEN 'unknown event source' WHEN expenditure_amount<0 THEN 'invalid amount' WHEN {STATUS}='bounced' THEN 'unknown payment status' END reason FROM r_events)""",
)
cte(
    "l_route",
    """SELECT g.*, CASE WHEN gate='processed' AND seq>f THEN 'duplicate' ELSE gate END event_status FROM l_gate g LEFT JOIN (SELECT event_id, min(seq) f FROM l_gate WHERE gate='processed' GROUP BY 1) USING (event_id)""",
)
cte("l_log", "SELECT * REPLACE (upper(event_type) AS event_type) FROM l_route WHERE event_status='processed'")
ORDER = "ORDER BY event_timestamp, event_type, event_id"
cte(
    "l_state",
    f"""SELECT project_id, coalesce(last(s {ORDER}) FILTER (s IS NOT NULL),'new') current_status, coalesce(last(recommended_amount {ORDER}) FILTER (recommended_amount IS NOT NULL),0) recommended_amount,
    coalesce(last(final_amount {ORDER}) FILTER (final_amount IS NOT NULL),0) final_amount, coalesce(CAST(sum(CAST(expenditure_amount AS DECIMAL(18,2))) FILTER (event_type='PAYMENT_RECEIVED') AS DOUBLE),0) total_expenditure,
    count(*) FILTER (event_type='PAYMENT_RECEIVED') payment_count, coalesce(last(payment_status {ORDER}) FILTER (payment_status IS NOT NULL),'unknown') latest_payment_status, max(event_timestamp) latest_event_timestamp,
    last(completed_date {ORDER}) FILTER (event_type='PROJECT_COMPLETED') completed_date, last(mp_name {ORDER}) mp_name, last(state {ORDER}) state, last(constituency {ORDER}) constituency FROM (SELECT *,
    CASE WHEN event_type IN ('PROJECT_CREATED','PROJECT_RECOMMENDED') THEN coalesce(project_status,'recommended') WHEN event_type='PROJECT_STATUS_UPDATED' THEN project_status WHEN event_type='PROJECT_COMPLETED' THEN 'completed' END s FROM l_log) GROUP BY 1""",
)
cte(
    "l_mp",
    "SELECT coalesce(mp_name,'Unknown MP') mp_name, count(*) project_count, CAST(sum(CAST(total_expenditure AS DECIMAL(18,2))) AS DOUBLE) expenditure_total, sum(payment_count)::BIGINT payment_count, count(*) FILTER (current_status='completed') completed_count FROM l_state GROUP BY 1",
)


def routed(t):
    return events.route_events(t.project_events, "seq")


def log(t):
    return routed(t).filter("event_status = 'processed'")


def state(t):
    return events.project_state(log(t))


@query(
    "L01_derive_events",
    """SELECT 'PROJECT_RECOMMENDED' event_type, work_id project_id, strftime(recommendation_date,'%Y-%m-%dT00:00:00Z') event_timestamp, recommended_amount amount, CAST(NULL AS VARCHAR) payment_status, CAST(NULL AS VARCHAR) mapping_status FROM k_master WHERE recommendation_date IS NOT NULL
    UNION ALL SELECT 'PROJECT_COMPLETED', work_id, strftime(completed_date,'%Y-%m-%dT00:00:00Z'), final_amount, NULL, NULL FROM k_master WHERE completed_date IS NOT NULL
    UNION ALL SELECT k, CASE WHEN n=1 THEN one END, strftime(expenditure_date,'%Y-%m-%dT00:00:00Z'), CASE WHEN k='PAYMENT_RECEIVED' THEN expenditure_amount END, payment_status, CASE WHEN n=1 THEN 'resolved' ELSE 'ambiguous' END
    FROM (SELECT *, unnest(['PAYMENT_RECEIVED','PAYMENT_STATUS_UPDATED']) k FROM r_payments) p JOIN (SELECT mp_name, constituency, state, replace(work_description,'lot ','-- LOT #') d, count(*) n, min(work_id) one FROM r_works GROUP BY ALL) w
    ON w.mp_name=p.mp_name AND w.constituency=p.constituency AND w.state=p.state AND d=work_description""",
)
def l01(t):
    master = master_of(t).withColumn("work_description", F.replace("work_description", F.lit("lot "), F.lit("-- LOT #")))
    out = events.derive_events(master, t.payments)
    return out.select(
        "event_type",
        F.when(F.coalesce("mapping_status", F.lit("resolved")) == "resolved", F.col("project_id")).alias("project_id"),
        "event_timestamp",
        F.coalesce("recommended_amount", "final_amount", "expenditure_amount").alias("amount"),
        "payment_status",
        "mapping_status",
    )


@query("L02_validate_events", "SELECT seq, payment_status, reason reject_reason FROM l_gate")
def l02(t):
    return events.validate_events(t.project_events).select("seq", "payment_status", "reject_reason")


@query("L03_mapping_gate", "SELECT seq, gate event_status FROM l_gate")
def l03(t):
    return events.gate_events(t.project_events).select("seq", "event_status")


@query("L04_dedupe_events", "SELECT seq, event_id, event_status FROM l_route")
def l04(t):
    return routed(t).select("seq", "event_id", "event_status")


@query("L05_status_counts", "SELECT event_status, count(*) events FROM l_route GROUP BY 1")
def l05(t):
    return events.status_counts(routed(t))


@query("L06_project_state", "SELECT * FROM l_state")
def l06(t):
    return state(t)


@query("L07_mp_state", "SELECT * FROM l_mp")
def l07(t):
    return events.mp_state(state(t))


DASHBOARD = """SELECT 'total_projects' metric, CAST(count(*) AS DOUBLE) AS value FROM l_state UNION ALL SELECT 'payments_processed', sum(payment_count) FROM l_state UNION ALL SELECT 'completed_projects', count(*) FROM l_state WHERE current_status='completed'
    UNION ALL SELECT 'pending_payments', count(*) FROM l_state WHERE latest_payment_status IN ('pending','in_progress','payment_in_progress') UNION ALL SELECT 'total_expenditure', CAST(sum(CAST(total_expenditure AS DECIMAL(18,2))) AS DOUBLE) FROM l_state
    UNION ALL SELECT 'status:'||current_status, count(*) FROM l_state GROUP BY current_status"""


@query("L08_stream_dashboard", DASHBOARD)
def l08(t):
    return events.dashboard(state(t))


@query("L09_project_history", "SELECT event_id, event_type, event_timestamp FROM l_log WHERE project_id='42'")
def l09(t):
    return events.project_history(log(t), "42").select("event_id", "event_type", "event_timestamp")


@query(
    "L10_progress_counts",
    """SELECT count(*) events_total, count(*) FILTER (event_status='processed') events_processed, count(*) FILTER (event_status<>'processed') events_remaining, count(*) FILTER (event_status='duplicate') duplicate_events,
    count(*) FILTER (event_status='invalid') invalid_events, count(*) FILTER (event_status='skipped') skipped_events, max(event_timestamp) FILTER (event_status='processed') latest_event_timestamp FROM l_route""",
)
def l10(t):
    return events.progress_counts(routed(t))


@query("P08_state_filter", "SELECT project_id, current_status, constituency FROM l_state WHERE lower(state)='state 2' AND current_status='completed'")
def p08(t):
    return events.filter_states(state(t), area="STATE 2", status="completed").select("project_id", "current_status", "constituency")


class EventStream(Tables):
    """The event table read as a stream of files."""

    def read(self, name):
        schema = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)


@query(
    "S07_log_sinks",
    "SELECT event_status, count(*) events FROM l_route GROUP BY 1",
)
def s07(t):
    out = scratch_path(t.spark, "log")
    jobs.start_log(EventStream(t.spark, t.sf_dir).project_events, out, f"{out}-checkpoint", once=True).awaitTermination()
    accepted = t.spark.read.json(f"{out}/events").select(F.lit("processed").alias("event_status"))
    refused = t.spark.read.json(f"{out}/errors").select("event_status")
    return events.status_counts(accepted.unionByName(refused))


def streamed_state(t):
    out = scratch_path(t.spark, "state")
    jobs.start_state(EventStream(t.spark, t.sf_dir).project_events, out, f"{out}-checkpoint", once=True).awaitTermination()
    return out


@query("L06_project_state_stream", "SELECT * FROM l_state")
def l06_stream(t):
    return jobs.load_state(t.spark, streamed_state(t))


@query("L07_mp_state_stream", "SELECT * FROM l_mp")
def l07_stream(t):
    return jobs.load_mp_state(t.spark, streamed_state(t))


@query("L08_stream_dashboard_stream", DASHBOARD)
def l08_stream(t):
    return jobs.load_dashboard(t.spark, streamed_state(t))
