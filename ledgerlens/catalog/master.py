"""Joins, payment aggregates, windows and feature engineering."""

from pyspark.sql import functions as F

from ledgerlens.catalog.quality import NORM
from ledgerlens.catalog.registry import MED, R, cte, query
from ledgerlens.functions.numbers import rounded
from ledgerlens.operators import features, fusion, master, ranking
from ledgerlens.schemas import FEATURE_COLUMNS, MASTER_COLUMNS, MP_COLUMNS
from ledgerlens.sources.testtables import AS_OF

DEC = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"
cte(
    "k_pay",
    f"""SELECT mp_name, constituency, state, {NORM.format("work_description")} d, {DEC.format("expenditure_amount")} total_expenditure,
    count(*) payment_count, count(*) FILTER (payment_status='successful') successful_payment_count,
    count(*) FILTER (payment_status='pending') pending_payment_count,
    last(payment_status ORDER BY expenditure_date, expenditure_amount, payment_status) latest_payment_status,
    first(vendor ORDER BY expenditure_date, expenditure_amount, vendor) primary_vendor,
    {DEC.format("expenditure_amount")}/count(*) average_payment, max(expenditure_amount) maximum_payment,
    min(expenditure_amount) minimum_payment FROM r_payments GROUP BY ALL""",
)
cte(
    "k_comp",
    """SELECT work_id, s.f final_amount, s.d completed_date, s.r average_rating FROM (SELECT work_id,
    last(struct_pack(f:=final_amount,d:=completed_date,r:=average_rating) ORDER BY completed_date,final_amount,average_rating) s
    FROM r_completions GROUP BY 1)""",
)
cte(
    "k_master",
    f"""SELECT w.project_id, w.work_id, work_description, category, w.mp_name, w.constituency, w.state, house, recommended_amount,
    recommendation_date, has_images, ida, final_amount, completed_date, average_rating, coalesce(total_expenditure,0) total_expenditure,
    coalesce(primary_vendor,'Unassigned / Pending') primary_vendor, coalesce(latest_payment_status,'No Transactions') latest_payment_status,
    coalesce(payment_count,0) payment_count, coalesce(successful_payment_count,0) successful_payment_count,
    coalesce(pending_payment_count,0) pending_payment_count,
    CASE WHEN completed_date IS NOT NULL THEN 'completed' WHEN recommendation_date IS NOT NULL THEN 'in_progress' ELSE 'recommended' END status,
    CASE WHEN recommended_amount>0 THEN coalesce(total_expenditure,0)/recommended_amount*100 END financial_progress_pct,
    CASE WHEN recommended_amount>0 THEN coalesce(total_expenditure,0)/recommended_amount END expenditure_ratio,
    average_payment, maximum_payment, minimum_payment
    FROM r_works w LEFT JOIN k_comp USING (work_id) LEFT JOIN k_pay p ON p.mp_name=w.mp_name AND p.constituency=w.constituency
    AND p.state=w.state AND p.d={NORM.format("work_description")}""",
)
cte(
    "k_peer",
    f"""SELECT category, state, {DEC.format("recommended_amount")}/count(recommended_amount) peer_mean_cost, stddev_samp(recommended_amount) peer_std_cost,
    {MED("recommended_amount")} peer_median_cost FROM r_works GROUP BY ALL""",
)
cte(
    "k_vendor",
    f"""SELECT vendor primary_vendor, count(DISTINCT work_description) vendor_project_count, {DEC.format("expenditure_amount")}
    vendor_total_expenditure, {DEC.format("expenditure_amount")}/count(*) vendor_average_project_cost FROM r_payments GROUP BY 1""",
)
cte(
    "k_feat",
    f"""SELECT project_id, mp_name, m.state, constituency, m.category, recommended_amount, final_amount, total_expenditure,
    (final_amount-recommended_amount)/recommended_amount*100 cost_variation_pct, total_expenditure/recommended_amount expenditure_ratio,
    payment_count, CASE WHEN payment_count>0 THEN total_expenditure/payment_count END average_payment, maximum_payment, minimum_payment,
    CASE WHEN payment_count>0 AND dd>0 THEN payment_count/CAST(dd AS DOUBLE) END payment_frequency, pending_payment_count,
    successful_payment_count, vendor_project_count, vendor_total_expenditure, vendor_average_project_cost,
    date_diff('day',recommendation_date,completed_date) recommendation_to_completion_days, dd days_since_recommendation,
    CAST(completed_date IS NOT NULL AS INT) is_completed, has_images, average_rating, peer_median_cost, peer_mean_cost, peer_std_cost,
    (recommended_amount-peer_median_cost)/peer_median_cost*100 cost_deviation_from_peer, CAST(NULL AS DOUBLE) description_similarity_score
    FROM (SELECT *, date_diff('day',CAST(recommendation_date AS DATE),DATE '{AS_OF}') dd FROM k_master) m
    LEFT JOIN k_peer p ON p.category IS NOT DISTINCT FROM m.category AND p.state=m.state LEFT JOIN k_vendor USING (primary_vendor)""",
)
DAY = {"recommendation_date", "completed_date"}
AMOUNTS = ["financial_progress_pct", "expenditure_ratio"]
MASTER_OUT = ", ".join(f"CAST({c} AS DATE) {c}" if c in DAY else c for c in MASTER_COLUMNS)
LOOSE = {"peer_mean_cost": 3, "peer_std_cost": 3}
FEATURES_OUT = ", ".join(f"{R(c, LOOSE[c])} {c}" if c in LOOSE else c for c in FEATURE_COLUMNS)


def master_of(t, **options):
    return master.build_master_works(t.works, t.completions, t.payments, **options)


def features_of(t, table=None):
    return features.create_project_features(
        master_of(t, extremes=True) if table is None else table, t.payments, AS_OF, peers=features.peer_statistics(t.works)
    )


def as_days(df):
    return df.withColumns({c: F.col(c).cast("date") for c in DAY if c in df.columns})


@query(
    "J01_join_completions",
    "SELECT project_id, final_amount, CAST(completed_date AS DATE) completed_date, average_rating FROM r_works LEFT JOIN k_comp USING (work_id)",
)
def j01(t):
    joined = master.join_completions(t.works, t.completions)
    return as_days(joined.select("project_id", "final_amount", "completed_date", "average_rating"))


PAY_OUT = "total_expenditure, payment_count, successful_payment_count, pending_payment_count, primary_vendor, latest_payment_status"


@query("J02_join_payments", f"SELECT project_id, {PAY_OUT} FROM k_master")
def j02(t):
    return master.join_payments(t.works, master.payment_aggregate(t.payments)).select("project_id", *PAY_OUT.split(", "))


@query(
    "J03_join_peers",
    f"""SELECT project_id, peer_median_cost, {R("peer_mean_cost", 3)} peer_mean_cost FROM r_works w LEFT JOIN k_peer p
    ON w.state=p.state AND w.category IS NOT DISTINCT FROM p.category""",
)
def j03(t):
    peers = features.with_peer_statistics(t.works)
    return peers.select("project_id", "peer_median_cost", rounded(F.col("peer_mean_cost"), 3).alias("peer_mean_cost"))


@query(
    "J04_join_vendors",
    "SELECT project_id, primary_vendor, vendor_project_count, vendor_total_expenditure FROM k_master LEFT JOIN k_vendor USING (primary_vendor)",
)
def j04(t):
    joined = features.with_vendor_statistics(master_of(t), t.payments)
    return joined.select("project_id", "primary_vendor", "vendor_project_count", "vendor_total_expenditure")


@query(
    "J07_mp_summary_join",
    "SELECT mp_name, works, allocated_amount, recommended_works FROM (SELECT mp_name, count(*) works FROM r_works GROUP BY 1) LEFT JOIN r_mp USING (mp_name)",
)
def j07(t):
    works = t.works.groupBy("mp_name").agg(F.count("*").alias("works"))
    return fusion.join_mp_summary(works, t.mp_summary).select("mp_name", "works", "allocated_amount", "recommended_works")


@query(
    "J08_membership",
    "SELECT work_id, mp_name FROM r_civic WHERE work_id IN (SELECT work_id FROM r_creports)",
)
def j08(t):
    return t.civic_works.join(t.citizen_reports, "work_id", "left_semi").select("work_id", "mp_name")


@query(
    "J09_lookup_joins",
    """SELECT w.work_id, coalesce(v,0) votes, coalesce(r,0) reports FROM r_civic w LEFT JOIN (SELECT work_id, count(*) v FROM r_votes GROUP BY 1) USING (work_id)
    LEFT JOIN (SELECT work_id, count(*) r FROM r_creports GROUP BY 1) USING (work_id)""",
)
def j09(t):
    votes = t.vote_actions.groupBy("work_id").agg(F.count("*").alias("votes"))
    reports = t.citizen_reports.groupBy("work_id").agg(F.count("*").alias("reports"))
    joined = fusion.lookup_join(fusion.lookup_join(t.civic_works, votes, "work_id", 0), reports, "work_id", 0)
    return joined.select("work_id", "votes", "reports")


@query(
    "J12_resolve_expenditures",
    """SELECT p.*, CASE WHEN n=1 THEN one END project_id, CASE WHEN n IS NULL THEN 'unresolved' WHEN n=1 THEN 'resolved' ELSE 'ambiguous' END mapping_status
    FROM (SELECT mp_name, work_description, expenditure_amount, state, constituency FROM r_payments) p LEFT JOIN (SELECT lower(mp_name) m, lower(state) s,
    lower(constituency) c, lower(replace(work_description,'lot ','-- LOT #')) d, count(DISTINCT work_id) n, min(work_id) one FROM r_works
    WHERE work_description NOT LIKE '2%' GROUP BY ALL)
    ON m=lower(mp_name) AND s=lower(p.state) AND c=lower(p.constituency) AND d=lower(work_description)""",
)
def j12(t):
    text = F.replace("work_description", F.lit("lot "), F.lit("-- LOT #"))
    # works whose description starts with 2 are written differently and resolve nothing
    works = t.works.withColumn("work_description", F.when(F.col("work_description").startswith("2"), F.concat(F.lit("revised "), text)).otherwise(text))
    out = master.resolve_expenditures(t.payments, works)
    return out.select(
        "mp_name", "work_description", "expenditure_amount", "state", "constituency", "project_id", "mapping_status"
    )


@query("A01_payment_aggregate", "SELECT * EXCLUDE (d), d normalized_work_description FROM k_pay")
def a01(t):
    return master.payment_aggregate(t.payments)


@query(
    "A02_vendor_features",
    f"""SELECT vendor, count(DISTINCT concat_ws('|',{NORM.format("work_description")},mp_name,constituency,state)) project_count,
    {DEC.format("expenditure_amount")} total_expenditure, {DEC.format("expenditure_amount")}/count(*) average_project_cost,
    {MED("expenditure_amount")} median_project_cost, count(*) FILTER (payment_status='successful') completed_project_count,
    count(*) FILTER (payment_status='pending') pending_payment_count, count(*) FILTER (payment_status='successful') successful_payment_count
    FROM r_payments GROUP BY 1""",
)
def a02(t):
    return master.build_vendor_features(t.payments)


@query("A03_vendor_lookup", "SELECT primary_vendor vendor, * EXCLUDE (primary_vendor) FROM k_vendor")
def a03(t):
    return master.vendor_lookup(t.payments)


@query(
    "A04_peer_statistics",
    f"SELECT category, state, peer_median_cost, {R('peer_mean_cost', 3)} peer_mean_cost, {R('peer_std_cost', 3)} peer_std_cost FROM k_peer",
)
def a04(t):
    return features.peer_statistics(t.works).withColumns({c: rounded(F.col(c), n) for c, n in LOOSE.items()})


@query("W01_competition_rank", "SELECT project_id, rank() OVER (ORDER BY cost_risk_score DESC) cost_rank FROM r_risk")
def w01(t):
    return ranking.competition_rank(t.risk, "cost_risk_score", "cost_rank").select("project_id", "cost_rank")


@query(
    "W02_sequence_rank",
    "SELECT project_id, row_number() OVER (ORDER BY overall_risk_score DESC, project_id) investigation_rank FROM r_risk",
)
def w02(t):
    order = [F.desc("overall_risk_score"), F.asc("project_id")]
    return ranking.sequence_rank(t.risk.select("project_id", "overall_risk_score"), order, "investigation_rank").drop("overall_risk_score")


@query(
    "W03_group_transform",
    f"""SELECT project_id, peer_median_cost, {R("peer_std_cost", 3)} peer_std_cost FROM r_works w LEFT JOIN k_peer p
    ON w.state=p.state AND w.category IS NOT DISTINCT FROM p.category""",
)
def w03(t):
    peers = features.with_peer_statistics(t.works)
    return peers.select("project_id", "peer_median_cost", rounded(F.col("peer_std_cost"), 3).alias("peer_std_cost"))


@query(
    "W04_keep_first_last",
    """SELECT project_id, first(event_id ORDER BY seq) first_event, last(event_id ORDER BY seq) last_event FROM r_events GROUP BY 1""",
)
def w04(t):
    events = t.project_events.select("project_id", "seq", "event_id")
    first = ranking.keep_first(events, ["project_id"], ["seq"]).select("project_id", F.col("event_id").alias("first_event"))
    last = ranking.keep_last(events, ["project_id"], ["seq"]).select("project_id", F.col("event_id").alias("last_event"))
    return first.join(last, "project_id")


@query("W05_first_last_value", "SELECT mp_name, constituency, state, d normalized_work_description, primary_vendor, latest_payment_status FROM k_pay")
def w05(t):
    return master.payment_aggregate(t.payments).select(*master.PAYMENT_KEY, "primary_vendor", "latest_payment_status")


@query("F01_master_works", f"SELECT {MASTER_OUT} FROM k_master")
def f01(t):
    return as_days(master_of(t))


@query(
    "F02_work_status",
    "SELECT work_id, CASE WHEN completed_date IS NOT NULL THEN 'completed' WHEN recommendation_date IS NOT NULL THEN 'in_progress' ELSE 'recommended' END status FROM r_works LEFT JOIN k_comp USING (work_id)",
)
def f02(t):
    joined = master.join_completions(t.works, t.completions)
    return joined.select("work_id", master.work_status(F.col("completed_date"), F.col("recommendation_date")).alias("status"))


@query(
    "F03_spend_ratio",
    """SELECT project_id, CASE WHEN b>0 THEN total_expenditure/b END ratio, CASE WHEN b<>0 THEN total_expenditure/b END feature_ratio,
    CASE WHEN b>0 THEN total_expenditure/b*100 END progress FROM (SELECT *, recommended_amount-100000 b FROM r_risk)""",
)
def f03(t):
    budget, spent = F.col("recommended_amount") - 100000, F.col("total_expenditure")
    return t.risk.select(
        "project_id",
        master.spend_ratio(spent, budget).alias("ratio"),
        master.spend_ratio(spent, budget, positive_only=False).alias("feature_ratio"),
        (master.spend_ratio(spent, budget) * 100).alias("progress"),
    )


@query("F04_cost_variation", "SELECT project_id, cost_variation_pct FROM k_feat")
def f04(t):
    joined = master.join_completions(t.works, t.completions)
    return joined.select(
        "project_id", features.cost_variation(F.col("final_amount"), F.col("recommended_amount")).alias("cost_variation_pct")
    )


@query(
    "F05_payment_features",
    """SELECT project_id, CASE WHEN payment_count>0 THEN total_expenditure/payment_count END average_payment,
    CASE WHEN payment_count>0 THEN greatest(total_expenditure,0) END maximum_payment, CASE WHEN payment_count>0 THEN greatest(total_expenditure,0) END
    minimum_payment, payment_frequency FROM k_feat""",
)
def f05(t):
    days = features.whole_days(F.col("recommendation_date"), F.lit(AS_OF).cast("timestamp"))
    base = master_of(t).withColumn("days_since_recommendation", days)
    out = features.payment_features(base, compat_max_payment=True)
    return base.withColumns(out).select("project_id", "average_payment", "maximum_payment", "minimum_payment", "payment_frequency")


@query("F06_elapsed_days", "SELECT project_id, recommendation_to_completion_days, days_since_recommendation FROM k_feat")
def f06(t):
    w = master.join_completions(t.works, t.completions)
    start = F.col("recommendation_date")
    return w.select(
        "project_id",
        features.whole_days(start, F.col("completed_date")).alias("recommendation_to_completion_days"),
        features.whole_days(start, F.lit(AS_OF).cast("timestamp")).alias("days_since_recommendation"),
    )


@query("F07_peer_deviation", "SELECT project_id, cost_deviation_from_peer FROM k_feat")
def f07(t):
    deviation = features.peer_deviation_pct(F.col("recommended_amount"), F.col("peer_median_cost"))
    return features.with_peer_statistics(t.works).select("project_id", deviation.alias("cost_deviation_from_peer"))


@query("F08_project_features", f"SELECT {FEATURES_OUT} FROM k_feat")
def f08(t):
    return features_of(t).withColumns({c: rounded(F.col(c), n) for c, n in LOOSE.items()})


@query(
    "F09_mp_features",
    f"SELECT {', '.join(MP_COLUMNS)}, total_expenditure/allocated_amount utilization_ratio, recommended_works-completed_works completion_gap FROM r_mp",
)
def f09(t):
    return features.create_mp_features(t.mp_summary)


@query("F10_master_mp", f"SELECT {', '.join(MP_COLUMNS)} FROM r_mp")
def f10(t):
    return master.build_master_mp(t.mp_summary)
