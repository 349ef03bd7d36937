"""Payment indicators, agency profiles, trends, alerts and case priority."""

from pyspark.sql import functions as F

from ledgerlens.catalog.master import features_of, master_of
from ledgerlens.catalog.registry import MED, R, SIG, cte, query
from ledgerlens.functions.numbers import rounded
from ledgerlens.operators import agency, master, payments, warning
from ledgerlens.session import materialize


def num(c):
    return f"coalesce({c},0e0)"


def round_sql(x):
    w = f"round_even({x},0)"
    steps = " ".join(f"WHEN {w}>={m} AND {w}%{m}=0 THEN {wt}e0" for m, wt in payments.ROUND_STEPS)
    return f"(CASE WHEN {x}>0 AND abs({x}-{w})<=0.05 AND {w}>=5000 THEN CASE {steps} ELSE 0e0 END ELSE 0e0 END)"


# round amounts are rare in the tables, so every fourth payment total is rounded up to 5,000
cte(
    "k_payin",
    f"""SELECT project_id, CASE WHEN total_expenditure>0 AND payment_count%4=0 THEN ceil(total_expenditure/5000)*5000 ELSE total_expenditure END total_expenditure,
    {num("recommended_amount")} recommended_amount, CAST(payment_count AS DOUBLE) payment_count, CAST(pending_payment_count AS DOUBLE) pending_payment_count,
    CASE WHEN payment_count%4=0 THEN ceil({num("average_payment")}/10000)*10000 ELSE {num("average_payment")} END average_payment,
    CASE WHEN payment_count%4=0 THEN ceil({num("maximum_payment")}/50000)*50000 ELSE {num("maximum_payment")} END maximum_payment,
    {num("payment_frequency")}*40 payment_frequency, {num("peer_median_cost")} peer_median_cost FROM k_feat""",
)


def payment_input(t):
    f = features_of(t)
    fourth = F.col("payment_count") % 4 == 0
    up = lambda c, step: F.when(fourth, F.ceil(F.coalesce(c, F.lit(0.0)) / step) * float(step)).otherwise(F.coalesce(c, F.lit(0.0)))
    return f.withColumns(
        {
            "total_expenditure": up("total_expenditure", 5000),
            "average_payment": up("average_payment", 10000),
            "maximum_payment": up("maximum_payment", 50000),
            "payment_frequency": F.col("payment_frequency") * 40,
        }
    )


RT, RA, RM = round_sql("total_expenditure"), round_sql("average_payment"), round_sql("maximum_payment")
ROUND = R(
    f"""CASE WHEN total_expenditure<=0 THEN 0e0 WHEN average_payment>0 AND maximum_payment>0 THEN 0.45e0*{RA}+0.35e0*{RM}+0.2e0*{RT}
    WHEN maximum_payment>0 THEN 0.55e0*{RM}+0.45e0*{RT} ELSE {RT} END""",
    4,
)
VEL = f"(CASE WHEN payment_frequency>0 THEN {SIG('payment_frequency', 5.0, 0.25)} ELSE 0e0 END)"
CHURN = """(CASE WHEN payment_count>=20 THEN 1e0 WHEN payment_count>=10 THEN 0.7e0+(payment_count-10)*0.03e0 WHEN payment_count>=5 THEN
 0.3e0+(payment_count-5)*0.08e0 WHEN payment_count>0 THEN 0.05e0 ELSE 0e0 END)"""
FRIC = "(CASE WHEN pending_payment_count>=5 THEN 0.85e0 WHEN pending_payment_count>=2 THEN 0.5e0 WHEN pending_payment_count>=1 THEN 0.25e0 ELSE 0e0 END)"
PEAK = f"greatest({VEL},{CHURN}*0.9e0,{FRIC}*0.8e0)"
FREQ = R(
    f"CASE WHEN payment_count<=0 AND pending_payment_count<=0 THEN 0e0 WHEN {VEL}>0.6 AND {CHURN}>0.5 THEN least(1e0,{PEAK}+0.15e0) ELSE least(1e0,{PEAK}) END",
    4,
)
SB = "(CASE WHEN recommended_amount>0 THEN recommended_amount ELSE 1e0 END)"
SP = "(CASE WHEN peer_median_cost>0 THEN peer_median_cost ELSE 500000e0 END)"
BR = f"(CASE WHEN total_expenditure>0 THEN least(1000e0,greatest(0e0,total_expenditure/{SB})) ELSE 0e0 END)"
PD = f"(CASE WHEN total_expenditure>0 THEN least(50000e0,greatest(-100e0,(total_expenditure-{SP})/{SP}*100)) ELSE 0e0 END)"
MAG = R(
    f"""CASE WHEN total_expenditure<=0 THEN 0e0 ELSE least(1e0,greatest(CASE WHEN {BR}>2 THEN 1e0 WHEN {BR}>1.05 THEN 0.5e0+({BR}-1.05e0)*0.4e0 ELSE 0e0 END,
    (CASE WHEN {PD}>=500 THEN 0.9e0 WHEN {PD}>=200 THEN 0.6e0 WHEN {PD}>=100 THEN 0.35e0 ELSE 0e0 END)*0.85e0,
    (CASE WHEN maximum_payment>=5e7 THEN 1e0 WHEN maximum_payment>=1e7 THEN 0.85e0 WHEN maximum_payment>=5e6 THEN 0.65e0 WHEN maximum_payment>=2.5e6 THEN 0.4e0 ELSE 0e0 END)*0.9e0)) END""",
    4,
)
cte(
    "k_ind",
    f"""SELECT *, {ROUND} round_payment_indicator, {FREQ} payment_frequency_indicator, {R(BR, 4)} budget_payment_ratio,
    {R(PD, 2)} peer_payment_deviation, {MAG} magnitude_risk_score, (CAST(split_part(project_id,'|',1) AS BIGINT)%101)/100e0 iso FROM k_payin""",
)


def isolation():
    return (F.split_part("project_id", F.lit("|"), F.lit(1)).cast("long") % 101) / 100.0


cte(
    "k_pays",
    f"""SELECT *, CASE WHEN total_expenditure<=0 AND pending_payment_count<=0 THEN 0e0 ELSE least(1e0,greatest(
    0.5e0*greatest(magnitude_risk_score,payment_frequency_indicator*0.9e0,round_payment_indicator*0.8e0)+0.35e0*iso+0.15e0*greatest(round_payment_indicator,payment_frequency_indicator),
    CASE WHEN budget_payment_ratio>2 AND total_expenditure>0 THEN 0.9e0 WHEN budget_payment_ratio>1.2 AND total_expenditure>0 THEN 0.7e0 ELSE 0e0 END,
    CASE WHEN payment_frequency_indicator>=0.8 OR payment_count>=25 THEN 0.85e0 ELSE 0e0 END, CASE WHEN pending_payment_count>=3 THEN 0.75e0 ELSE 0e0 END)) END comp,
    CASE WHEN total_expenditure<=0 AND pending_payment_count<=0 THEN 'NORMAL' ELSE coalesce(nullif(concat_ws('|',
    CASE WHEN budget_payment_ratio>2 AND total_expenditure>0 THEN 'SEVERE_BUDGET_OVERRUN' WHEN budget_payment_ratio>1.05 AND total_expenditure>0 THEN 'BUDGET_OVERRUN' END,
    CASE WHEN payment_frequency_indicator>=0.65 THEN 'RAPID_PAYMENT_BURST' END, CASE WHEN round_payment_indicator>=0.65 THEN 'ROUND_FIGURE_DISBURSEMENT' END,
    CASE WHEN payment_count>=15 THEN 'TRANSACTION_CHURN_STRUCTURING' END,
    CASE WHEN CASE WHEN maximum_payment<=0 AND total_expenditure>0 THEN total_expenditure ELSE maximum_payment END>=5000000 THEN 'LARGE_SINGLE_PAYMENT' END,
    CASE WHEN pending_payment_count>=2 THEN 'PENDING_DISPUTE_RISK' END),''),'NORMAL') END typ FROM k_ind""",
)


@query(
    "Y01_amount_roundness",
    f"SELECT project_id, total_expenditure, {RT} roundness FROM k_payin",
)
def y01(t):
    return payment_input(t).select("project_id", "total_expenditure", payments.amount_roundness(F.col("total_expenditure")).alias("roundness"))


@query("Y02_round_payments", "SELECT project_id, round_payment_indicator FROM k_ind")
def y02(t):
    return payments.payment_indicators(payment_input(t)).select("project_id", "round_payment_indicator")


@query("Y03_payment_frequency", "SELECT project_id, payment_frequency_indicator FROM k_ind")
def y03(t):
    return payments.payment_indicators(payment_input(t)).select("project_id", "payment_frequency_indicator")


@query("Y04_unusual_payments", "SELECT project_id, budget_payment_ratio, peer_payment_deviation, magnitude_risk_score FROM k_ind")
def y04(t):
    return payments.payment_indicators(payment_input(t)).select(
        "project_id", "budget_payment_ratio", "peer_payment_deviation", "magnitude_risk_score"
    )


@query(
    "Y05_payment_inputs",
    f"SELECT project_id, recommended_amount, payment_count, pending_payment_count, 0e0 average_payment, {R('CASE WHEN total_expenditure<=0 THEN 0e0 ELSE ' + RT + ' END', 4)} round_payment_indicator FROM k_payin",
)
def y05(t):
    thin = payment_input(t).drop("average_payment", "maximum_payment", "payment_frequency", "peer_median_cost")
    return payments.payment_indicators(thin).select(
        "project_id", "recommended_amount", "payment_count", "pending_payment_count", "average_payment", "round_payment_indicator"
    )


@query("Y06_payment_composite", f"SELECT project_id, {R('comp', 4)} score FROM k_pays")
def y06(t):
    ready = payments.payment_indicators(payment_input(t))
    return ready.select("project_id", rounded(payments.payment_composite(isolation()), 4).alias("score"))


@query("Y07_payment_typology", "SELECT project_id, typ payment_anomaly_type FROM k_pays")
def y07(t):
    ready = payments.payment_indicators(payment_input(t))
    return ready.select("project_id", payments.payment_typology().alias("payment_anomaly_type"))


@query(
    "Y08_payment_scores_given_isolation",
    f"""SELECT project_id, payment_anomaly_score, is_payment_anomaly, payment_anomaly_type, payment_count, total_payment_amount, rank() OVER (ORDER BY payment_anomaly_score DESC) payment_anomaly_rank
    FROM (SELECT project_id, {R("comp", 4)} payment_anomaly_score, CAST(comp>=0.5 AS INT) is_payment_anomaly, typ payment_anomaly_type, CAST(payment_count AS BIGINT) payment_count,
    {R("total_expenditure", 2)} total_payment_amount FROM k_pays)""",
)
def y08(t):
    ready = payments.payment_indicators(payment_input(t)).withColumn("iso", isolation())
    return payments.score_payments(ready, "iso").select(
        "project_id", "payment_anomaly_score", "is_payment_anomaly", "payment_anomaly_type", "payment_count",
        "total_payment_amount", "payment_anomaly_rank",
    )


# --- agencies -------------------------------------------------------------------------------------

cte(
    "k_vfeat",
    f"""SELECT vendor, count(DISTINCT project) project_count, {MED("amount")} median_project_cost,
    CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) total_expenditure, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)/count(*) average_project_cost,
    count(*) FILTER (payment_status='successful') completed_project_count, count(*) FILTER (payment_status='pending') pending_payment_count
    FROM (SELECT vendor, expenditure_amount amount, payment_status, concat_ws('|',work_description,mp_name,constituency,state) project FROM r_payments) GROUP BY 1""",
)
SKEW = "(CASE WHEN mean>0 THEN mean/(CASE WHEN med>0 THEN med WHEN mean>0 THEN mean ELSE 1e0 END) ELSE 1e0 END)"
cte(
    "k_perf",
    f"""SELECT agency_id, agency_id agency_name, n total_projects, done completed_projects, n-done ongoing_projects, {R("done/CAST(n AS DOUBLE)*100", 2)} completion_rate,
    {R("spent", 2)} total_expenditure, {R("mean", 2)} average_project_cost, {R("med", 2)} median_project_cost, 100e0 average_utilization,
    pend pending_payment_count, {R("pend/CAST(n AS DOUBLE)", 4)} pending_payment_rate, {R(f"least(50e0,greatest(0.1e0,{SKEW}))", 2)} cost_skewness,
    0::BIGINT anomaly_count, 0::BIGINT high_risk_project_count,
    pend/CAST(n AS DOUBLE) pr FROM (SELECT vendor agency_id, greatest(1,project_count) n, least(greatest(completed_project_count,0),greatest(1,project_count)) done,
    total_expenditure spent, average_project_cost mean, median_project_cost med, pending_payment_count pend FROM k_vfeat)""",
)
cte(
    "k_vdelay",
    f"""SELECT *, {R("least(100e0,pr*100)", 2)} delay_rate, {R("pr*90", 1)} average_delay_days,
    {R("least(100e0,0.6e0*least(100e0,pr*80+pending_payment_count*5e0)+0.4e0*CASE WHEN total_projects>=3 THEN 100-completion_rate ELSE 20e0 END)", 2)} delay_risk FROM k_perf""",
)
# project rows: the vendor of the first payment, delayed when the completion took more than 400 days
cte(
    "k_projin",
    """SELECT primary_vendor agency_name, CAST(recommendation_to_completion_days>400 AS INT) is_delayed, greatest(0,recommendation_to_completion_days-400) delay_days,
    f.* FROM k_feat f JOIN (SELECT project_id, primary_vendor FROM k_master) USING (project_id)""",
)
PRATE = "late/CAST(n AS DOUBLE)*100"
cte(
    "k_pperf",
    f"""SELECT a agency_id, a agency_name, n total_projects, least(done,n) completed_projects, n-least(done,n) ongoing_projects, {R("least(done,n)/CAST(n AS DOUBLE)*100", 2)} completion_rate,
    {R("spent", 2)} total_expenditure, {R("mean", 2)} average_project_cost, {R("med", 2)} median_project_cost, {R("usage", 2)} average_utilization,
    pend pending_payment_count, {R("pend/CAST(n AS DOUBLE)", 4)} pending_payment_rate, {R(SKEW, 2)} cost_skewness, late anomaly_count, late high_risk_project_count,
    {R(PRATE, 2)} delay_rate, {R("coalesce(ldays,0)", 1)} average_delay_days, {R(f"least(100e0,{PRATE}*0.7e0+least(100e0,coalesce(ldays,0)/180*30))", 2)} delay_risk
    FROM (SELECT agency_name a, count(*) n, sum(is_completed)::BIGINT done, CAST(sum(CAST(total_expenditure AS DECIMAL(18,2))) AS DOUBLE) spent,
    CAST(sum(CAST(total_expenditure AS DECIMAL(18,2))) AS DOUBLE)/count(*) mean, {MED("total_expenditure")} med,
    avg(CASE WHEN total_expenditure>0 THEN total_expenditure/(CASE WHEN recommended_amount>0 THEN recommended_amount ELSE 1e0 END)*100 ELSE 100e0 END) usage,
    sum(pending_payment_count)::BIGINT pend, coalesce(sum(is_delayed),0)::BIGINT late, avg(CASE WHEN delay_days>0 THEN delay_days END) ldays FROM k_projin GROUP BY 1)""",
)


def project_rows(t):
    days = F.col("recommendation_to_completion_days")
    table = materialize(master_of(t, extremes=True), "master")
    vendors = table.select("project_id", F.col("primary_vendor").alias("agency_name"))
    return features_of(t, table).join(vendors, "project_id").withColumns(
        {"is_delayed": (days > 400).cast("int"), "delay_days": F.greatest(F.lit(0), days - 400), "is_anomaly": (days > 400).cast("int")}
    )


RAW = """0.28e0*delay_risk+0.24e0*(CASE WHEN total_projects>=2 THEN greatest(0e0,100-completion_rate) ELSE 20e0 END)
 +0.2e0*greatest(least(100e0,greatest(0e0,(cost_skewness-1)*35)),CASE WHEN average_utilization>105 THEN least(100e0,greatest(0e0,(average_utilization-100)*1.5e0)) ELSE 0e0 END)
 +0.16e0*least(100e0,pending_payment_rate*75+pending_payment_count*6e0)
 +0.12e0*least(100e0,anomaly_count/CAST(total_projects AS DOUBLE)*60+high_risk_project_count/CAST(total_projects AS DOUBLE)*40)"""
WGT = "(total_projects/(total_projects+3e0))"
ADJ = f"least(100e0,greatest(0e0,{WGT}*({RAW})+(1-{WGT})*15e0))"


def profile_sql(source):
    f1 = lambda x, d: "printf('%." + str(d) + "f'," + R(x, d) + ")"
    reasons = f"""concat_ws('; ', CASE WHEN total_projects<3 THEN 'Low historical volume (score credibility shrunk toward baseline)' END,
    CASE WHEN delay_rate>=40 THEN 'High historical delay rate ('||{f1("delay_rate", 1)}||'%)' WHEN average_delay_days>=60 THEN 'Significant average project delay ('||{f1("average_delay_days", 0)}||' days)' END,
    CASE WHEN completion_rate<20 AND total_projects>=3 THEN 'Low project completion rate ('||{f1("completion_rate", 1)}||'%)' END,
    CASE WHEN pending_payment_count>=2 THEN 'High pending payment friction ('||pending_payment_count||' pending payments)' END,
    CASE WHEN cost_skewness>=1.5 AND total_projects>=2 THEN 'Significant cost skewness (mean project cost '||{f1("cost_skewness", 1)}||'x median)' END,
    CASE WHEN anomaly_count>0 THEN 'Historical cost/project anomalies recorded ('||anomaly_count||' projects)' END,
    CASE WHEN average_utilization>120 THEN 'Average expenditure exceeds sanctioned budget ('||{f1("average_utilization", 1)}||'%)' END)"""
    return f"""SELECT *, {R("adj", 2)} agency_risk_score, lvl agency_risk_level, lvl risk_level, CASE WHEN why<>'' THEN why WHEN lvl='LOW' THEN
    'Consistent on-time project execution with low operational friction' ELSE 'Moderate overall operational and financial performance' END risk_reasons
    FROM (SELECT *, CASE WHEN adj<30 THEN 'LOW' WHEN adj<55 THEN 'MEDIUM' WHEN adj<75 THEN 'HIGH' ELSE 'CRITICAL' END lvl FROM
    (SELECT *, {ADJ} adj, {reasons} why FROM {source}))"""


cte("k_agency", profile_sql("k_vdelay"))
cte("k_pagency", profile_sql("k_pperf"))


def vendors(t):
    return master.build_vendor_features(t.payments)


@query(
    "Z01_performance_paths",
    "SELECT 'vendor' path, agency_id, total_projects, completion_rate FROM k_perf UNION ALL SELECT 'project', agency_id, total_projects, completion_rate FROM k_pperf",
)
def z01(t):
    cols = ["agency_id", "total_projects", "completion_rate"]
    a = agency.vendor_performance(vendors(t)).select(F.lit("vendor").alias("path"), *cols)
    return a.unionByName(agency.project_performance(project_rows(t), "agency_name").select(F.lit("project").alias("path"), *cols))


@query("Z02_vendor_performance", "SELECT * EXCLUDE (pr) FROM k_perf")
def z02(t):
    return agency.vendor_performance(vendors(t))


@query("Z03_project_delay_history", "SELECT agency_id, delay_rate, average_delay_days, delay_risk FROM k_pperf")
def z03(t):
    return agency.project_performance(project_rows(t), "agency_name").select("agency_id", "delay_rate", "average_delay_days", "delay_risk")


@query("Z04_vendor_delay_history", "SELECT agency_id, delay_rate, average_delay_days, delay_risk FROM k_vdelay")
def z04(t):
    done = agency.vendor_delay_history(agency.vendor_performance(vendors(t)))
    return done.select("agency_id", "delay_rate", "average_delay_days", "delay_risk")


@query("A11_project_agency_aggregate", "SELECT * FROM k_pperf")
def a11(t):
    return agency.project_performance(project_rows(t), "agency_name")


@query("Z05_agency_score", "SELECT agency_id, agency_risk_score FROM k_agency")
def z05(t):
    return agency.profile_vendors(vendors(t)).select("agency_id", "agency_risk_score")


@query("Z06_agency_level", "SELECT agency_id, agency_risk_level FROM k_agency")
def z06(t):
    return agency.profile_vendors(vendors(t)).select("agency_id", "agency_risk_level")


@query("Z07_agency_reasons", f"SELECT {', '.join(agency.PROFILE)} FROM k_pagency")
def z07(t):
    return agency.profile_projects(project_rows(t), "agency_name")


@query(
    "Z08_vendor_risk_wiring",
    "SELECT r.project_id, agency_risk_score vendor_risk_score, agency_risk_level vendor_risk_level FROM r_risk r JOIN k_master m USING (project_id) LEFT JOIN k_agency ON agency_id=primary_vendor",
)
def z08(t):
    wired = agency.with_vendor_risk(t.risk, master_of(t), agency.profile_vendors(vendors(t)))
    return wired.select("project_id", "vendor_risk_score", "vendor_risk_level")


# --- trends, alerts, priority ---------------------------------------------------------------------

cte(
    "k_trend",
    f"""SELECT project_id, days_since_recommendation, spend_velocity_daily, peer_median_velocity, velocity_ratio_vs_peer,
    ratio>=2.5 AND NOT done AND spent>50000 is_runaway_spend, days_since_recommendation>=365 AND use<0.1 AND NOT done is_stalled_decay,
    CASE WHEN ratio>=2.5 AND NOT done AND spent>50000 THEN 'RUNAWAY_BURN' WHEN days_since_recommendation>=365 AND use<0.1 AND NOT done THEN 'STALLED_DECAY'
    WHEN ratio>=1.5 THEN 'ACCELERATED' WHEN days_since_recommendation<90 THEN 'NEW_PROJECT' ELSE 'NORMAL' END burn_rate_status
    FROM (SELECT *, CASE WHEN peer_median_velocity>0 THEN {R("spend_velocity_daily/peer_median_velocity", 2)} ELSE 1e0 END velocity_ratio_vs_peer,
    CASE WHEN peer_median_velocity>0 THEN {R("spend_velocity_daily/peer_median_velocity", 2)} ELSE 1e0 END ratio
    FROM (SELECT b.*, {R("m", 2)} peer_median_velocity FROM k_tbase b JOIN (SELECT c, s, {MED("spend_velocity_daily")} m FROM k_tbase GROUP BY ALL) p USING (c,s)))""",
)
cte(
    "k_tbase",
    f"""SELECT project_id, greatest(1e0,CAST(coalesce(days_since_recommendation,0) AS DOUBLE)) days_since_recommendation,
    {R("total_expenditure/greatest(1e0,CAST(coalesce(days_since_recommendation,0) AS DOUBLE))", 2)} spend_velocity_daily,
    coalesce(category,'Other') c, state s, is_completed=1 done, total_expenditure spent, CASE WHEN recommended_amount>0 THEN total_expenditure/recommended_amount ELSE 0e0 END use FROM k_feat""",
)


@query("E01_trends", "SELECT * FROM k_trend")
def e01(t):
    return warning.analyze_trends(features_of(t))


cte(
    "k_alertin",
    """SELECT f.project_id, mp_name, state, recommended_amount, total_expenditure, coalesce(expenditure_ratio,0) ratio, t.days_since_recommendation d, is_completed,
    spend_velocity_daily v, peer_median_velocity pv, burn_rate_status, 200+CAST(split_part(f.project_id,'|',1) AS BIGINT)%600 pred,
    (CAST(split_part(f.project_id,'|',1) AS BIGINT)%97)/100e0 pay FROM k_feat f JOIN k_trend t USING (project_id)""",
)


def alert_input(t):
    n = F.split_part("project_id", F.lit("|"), F.lit(1)).cast("long")
    return features_of(t).withColumns({"predicted_completion_days": 200 + n % 600, "payment_risk_score": (n % 97) / 100.0})


F0 = "printf('%.0f',"
ALERT_SQL = {
    "WARN_BUDGET_OVERRUN": ("ratio>1.1 AND total_expenditure>100000", "CRITICAL",
        "'Expenditure exceeds sanctioned amount by '||printf('%.1f'," + R("(ratio-1)*100", 1) + ")||'% (Spent: ₹'||format('{:,.0f}',total_expenditure)||' vs Sanctioned: ₹'||format('{:,.0f}',recommended_amount)||')'"),
    "WARN_RUNAWAY_VELOCITY": ("burn_rate_status='RUNAWAY_BURN'", "WARNING",
        "'Project is burning funds at ₹'||printf('%.0f'," + R("v", 0) + ")||'/day ('||printf('%.1f'," + R("v/greatest(pv,1e0)", 1) + ")||'x peer median rate) while incomplete.'"),
    "WARN_CHRONIC_STALL": ("d>=365 AND ratio<0.1 AND is_completed<>1", "WARNING",
        "'Work has remained dormant for '||CAST(d AS BIGINT)||' days since recommendation with <10% utilization.'"),
    "WARN_IMPENDING_DELAY": ("pred>=500 AND is_completed<>1", "ADVISORY",
        "'ML model forecasts completion will require ~'||pred||' days based on agency friction and history.'"),
    "WARN_PAYMENT_CHURN": ("pay>=0.7", "CRITICAL", "'Unusual burst or round-sum payment pattern flagged by payment anomaly detector.'"),
}


def alert_sql(code):
    when, severity, detail = ALERT_SQL[code]
    return f"SELECT project_id, mp_name, state, '{code}' alert_code, '{severity}' alert_severity, {detail} alert_detail FROM k_alertin WHERE {when}"


ALERT_OUT = ["project_id", "mp_name", "state", "alert_code", "alert_severity", "alert_detail"]
for _name, _code, _alert in (
    ("E02_budget_overrun", "WARN_BUDGET_OVERRUN", warning.budget_overrun),
    ("E03_runaway_velocity", "WARN_RUNAWAY_VELOCITY", warning.runaway_velocity),
    ("E04_chronic_stall", "WARN_CHRONIC_STALL", warning.chronic_stall),
    ("E05_impending_delay", "WARN_IMPENDING_DELAY", warning.impending_delay),
    ("E06_payment_churn", "WARN_PAYMENT_CHURN", warning.payment_churn),
):

    def _run(t, alert=_alert):
        if alert is not warning.runaway_velocity:
            return warning.generate_alerts(alert_input(t), None, [alert]).select(*ALERT_OUT)
        df = materialize(alert_input(t), "features")
        return warning.generate_alerts(df, warning.analyze_trends(df), [alert]).select(*ALERT_OUT)

    query(_name, alert_sql(_code).replace("d>=365", "d>=365"))(_run)


@query("E07_alerts", " UNION ALL ".join(alert_sql(c) for c in ALERT_SQL))
def e07(t):
    df = materialize(alert_input(t), "features")  # read for the alerts, and several times for the trends
    return warning.generate_alerts(df, warning.analyze_trends(df)).select(*ALERT_OUT)


PRAW = "(overall_risk_score*0.6e0+least(1e0,greatest(0e0,(log10(least(5e7,greatest(1e4,total_expenditure)))-4)/3.7e0))*0.4e0)*100"
cte(
    "k_prio",
    f"""SELECT project_id, {R("p", 2)} investigation_priority_score, CASE WHEN overall_risk_score>=0.7 OR p>=65 THEN 'TIER_1_IMMEDIATE_ACTION'
    WHEN overall_risk_score>=0.45 OR p>=45 THEN 'TIER_2_PRIORITY_INSPECTION' WHEN overall_risk_score>=0.25 OR p>=30 THEN 'TIER_3_DESK_REVIEW' ELSE 'TIER_4_ROUTINE' END
    investigation_urgency, overall_risk_score>=0.7 OR p>=65 audit_dispatch_recommended FROM (SELECT *, {PRAW} p FROM r_risk)""",
)
PRIO_OUT = ["project_id", "investigation_priority_score", "investigation_urgency", "audit_dispatch_recommended"]


@query("K01_case_priority", "SELECT * FROM k_prio")
def k01(t):
    return warning.prioritize_cases(t.risk).select(*PRIO_OUT)


@query(
    "K02_rank_cases",
    "SELECT project_id, investigation_priority_score, row_number() OVER (ORDER BY investigation_priority_score DESC, project_id) investigation_rank FROM k_prio ORDER BY 3 LIMIT 200",
)
def k02(t):
    return warning.rank_cases(t.risk, 200).select("project_id", "investigation_priority_score", "investigation_rank")
