"""Data-quality reports and issue rows."""

from pyspark.sql import functions as F

from ledgerlens.catalog.cleaning import messy, raw_works
from ledgerlens.catalog.registry import MED, R, cte, query
from ledgerlens.functions.numbers import rounded
from ledgerlens.operators import quality as q


def repeated_lines(t):
    """Line items without their amounts: many exact repeats."""
    return t.read("lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_tax")


@query("V01_exact_dedupe", "SELECT DISTINCT l_suppkey, l_linenumber, l_returnflag, l_tax FROM lineitem")
def v01(t):
    return repeated_lines(t).dropDuplicates()


@query(
    "V02_duplicate_report",
    """SELECT 'lines' dataset, sum(c)::BIGINT rows_before, (sum(c)-count(*))::BIGINT exact_duplicates, count(*) rows_after FROM
    (SELECT count(*) c FROM lineitem GROUP BY l_suppkey,l_linenumber,l_returnflag,l_tax)
    UNION ALL SELECT 'works', count(*)+count(*) FILTER (o_orderkey%5=0), count(*) FILTER (o_orderkey%5=0), count(*) FROM orders""",
)
def v02(t):
    return q.duplicate_report({"lines": repeated_lines(t), "works": raw_works(t)})


@query(
    "V03_missing_report",
    f"""SELECT dataset, column_name, missing_count, {R("missing_count/CAST(n AS DOUBLE)*100", 2)} missing_percentage FROM (
    SELECT 'works' dataset, 'category' column_name, count(*) FILTER (category IS NULL) missing_count, count(*) n FROM r_works
    UNION ALL SELECT 'works', 'recommended_amount', count(*) FILTER (recommended_amount IS NULL), count(*) FROM r_works
    UNION ALL SELECT 'works', 'recommendation_date', count(*) FILTER (recommendation_date IS NULL), count(*) FROM r_works
    UNION ALL SELECT 'places', 'latitude', count(*) FILTER (latitude IS NULL), count(*) FROM r_coords
    UNION ALL SELECT 'places', 'longitude', count(*) FILTER (longitude IS NULL), count(*) FROM r_coords)""",
)
def v03(t):
    return q.missing_report({"works": t.works, "places": t.coordinates})


ISSUE = "SELECT '{d}' dataset, '{t}' issue_type, '{c}' issue_category, '{f}' field, CAST({r} AS VARCHAR) row_id, '{m}' AS message FROM {s} WHERE {w}"


def sql_issue(d, t, c, f, r, m, s, w):
    return ISSUE.format(d=d, t=t, c=c, f=f, r=r, m=m, s=s, w=w)


E_, A_ = q.ERROR, q.ANOMALY


@query("V04_missing_key", sql_issue("events", "missing_mp_name", E_, "mp_name", "seq", "mp_name is missing", "r_events", "mp_name IS NULL"))
def v04(t):
    return q.issues(t.project_events, "events", "seq", q.missing_key_checks("mp_name"))


@query(
    "V05_duplicate_key",
    """SELECT 'events' dataset, 'duplicate_event_id' issue_type, 'DATA_QUALITY_ERROR' issue_category, 'event_id' field,
    CAST(seq AS VARCHAR) row_id, 'Duplicate event_id detected' AS message FROM (SELECT seq, count(*) OVER (PARTITION BY event_id) n FROM r_events) WHERE n>1""",
)
def v05(t):
    return q.duplicate_key_issues(t.project_events, "events", "event_id", "seq")


@query(
    "V06_amount_checks",
    " UNION ALL ".join(
        [
            sql_issue("customer", "negative_amount", A_, "c_acctbal", "c_custkey", "c_acctbal is negative", "customer", "c_acctbal<0"),
            sql_issue("customer", "zero_amount", A_, "c_acctbal", "c_custkey", "c_acctbal is zero", "customer", "c_acctbal=0"),
            sql_issue("works", "zero_amount", A_, "recommended_amount", "work_id", "recommended_amount is zero", "r_works", "coalesce(recommended_amount,0)=0"),
        ]
    ),
)
def v06(t):
    accounts = q.issues(t.read("customer"), "customer", "c_custkey", q.amount_checks(["c_acctbal"]))
    return accounts.unionByName(q.issues(t.works, "works", "work_id", q.amount_checks(["recommended_amount"])))


STATUS_ISSUE = sql_issue(
    "messy", "invalid_payment_status", E_, "status", "o_orderkey", "Payment status is not in the accepted set", "m_orders",
    f"NOT coalesce(lower(status) IN {tuple(q.ACCEPTED_STATUSES)},false)",
)


@query("V07_status_vocabulary", STATUS_ISSUE)
def v07(t):
    return q.issues(messy(t), "messy", "o_orderkey", q.status_checks("status"))


REQUIRED_ISSUE = " UNION ALL ".join(
    sql_issue("events", f"missing_{c}", E_, c, "seq", f"{c} is missing", "r_events", f"coalesce(trim({c}),'')=''")
    for c in ("mp_name", "constituency", "state")
)


@query("V08_required_fields", REQUIRED_ISSUE)
def v08(t):
    return q.issues(t.project_events, "events", "seq", q.required_checks(["mp_name", "constituency", "state"]))


PERCENT_ISSUE = " UNION ALL ".join(
    sql_issue("mp", "invalid_percentage", E_, c, "mp_name", f"{c} is out of range", "r_mp", f"{c}<0 OR {c}>100")
    for c in ("utilization_pct", "completion_rate_pct")
)


@query("V09_percentage_range", PERCENT_ISSUE)
def v09(t):
    return q.issues(t.mp_summary, "mp", "mp_name", q.percentage_checks(["utilization_pct", "completion_rate_pct"]))


@query(
    "V10_issue_counts",
    f"SELECT issue_category, count(*) issues FROM ({STATUS_ISSUE} UNION ALL {REQUIRED_ISSUE} UNION ALL {PERCENT_ISSUE}) GROUP BY 1",
)
def v10(t):
    return q.issue_counts(q.union_all([v07(t), v08(t), v09(t)]))


NORM = "trim(regexp_replace(lower(coalesce({0},'')),'[^a-z0-9]+',' ','g'))"
cte("k_works", f"SELECT mp_name, constituency, state, {NORM.format('work_description')} d, count(*) c FROM r_works GROUP BY ALL")


@query(
    "V11_expenditure_matching",
    f"""SELECT p.mp_name, p.constituency, p.state, p.work_description, coalesce(c,0) candidate_count,
    CASE WHEN c=1 THEN 'matched' WHEN c>1 THEN 'ambiguous' ELSE 'unmatched' END match_status
    FROM (SELECT * FROM r_payments) p LEFT JOIN (SELECT * FROM k_works WHERE d NOT LIKE '1%') k
    ON k.mp_name=p.mp_name AND k.constituency=p.constituency AND k.state=p.state AND k.d={NORM.format("p.work_description")}""",
)
def v11(t):
    # works whose description starts with 1 are written differently and match nothing
    text = F.col("work_description")
    return q.expenditure_matching(t.payments, t.works.withColumn("work_description", F.when(text.startswith("1"), F.concat(F.lit("revised "), text)).otherwise(text)))


@query(
    "V12_allocation_reconciliation",
    """SELECT mp_name, constituency, state, a allocation_from_excel, allocated_amount allocation_from_mp_summary,
    a-allocated_amount difference, CASE WHEN a IS NOT NULL AND allocated_amount IS NOT NULL THEN CASE WHEN abs(a-allocated_amount)<=1e-6
    THEN 'match' ELSE 'difference' END WHEN a IS NOT NULL THEN 'missing_in_summary' ELSE 'missing_in_excel' END reconciliation_status
    FROM r_mp LEFT JOIN (SELECT c_name mp_name, CASE WHEN c_custkey%5=0 THEN c_acctbal ELSE s END a FROM customer JOIN
    (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) s FROM orders GROUP BY 1) ON o_custkey=c_custkey WHERE c_custkey%7<>0) USING (mp_name)""",
)
def v12(t):
    totals = t.read("orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("s"))
    second = (
        t.read("customer")
        .join(totals, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            # a seventh is listed under another name
            F.when(F.col("c_custkey") % 7 == 0, F.concat("c_name", F.lit(" (old)"))).otherwise(F.col("c_name")).alias("mp_name"),
            F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal")).otherwise(F.col("s")).alias("allocation"),
        )
    )
    return q.allocation_reconciliation(t.mp_summary, second)


def sql_quality(column, dtype, numeric, source):
    x = f"CAST({column} AS DOUBLE)"
    nums = f"min({x}) \"min\", max({x}) \"max\", {R(f'avg({x})', 3)} \"mean\", {MED(x)} \"median\"" if numeric else (
        'CAST(NULL AS DOUBLE) "min", CAST(NULL AS DOUBLE) "max", CAST(NULL AS DOUBLE) "mean", CAST(NULL AS DOUBLE) "median"')
    usable = f"count(*) FILTER ({column} IS NULL) < greatest(1,floor(count(*)*0.5))" if numeric else "false"
    return f"""SELECT '{column}' feature_name, '{dtype}' dtype, count(*) FILTER ({column} IS NULL) missing_count,
    {R(f"count(*) FILTER ({column} IS NULL)/CAST(count(*) AS DOUBLE)*100", 2)} missing_percentage,
    count(DISTINCT {column}) unique_values, {nums}, {usable} usable_for_ml,
    CASE WHEN {usable} THEN 'Numeric feature usable for ML.' ELSE 'Categorical or highly sparse; use with caution.' END notes
    FROM {source}"""


@query(
    "V13_feature_quality",
    " UNION ALL ".join(
        sql_quality(c, d, n, "r_works")
        for c, d, n in (
            ("project_id", "string", False), ("category", "string", False), ("state", "string", False),
            ("recommended_amount", "double", True), ("has_images", "boolean", True),
        )
    ),
)
def v13(t):
    df = t.works.select("project_id", "category", "state", "recommended_amount", "has_images")
    return q.feature_quality_report(df).withColumn("mean", rounded(F.col("mean"), 3))


@query(
    "V15_key_report",
    """SELECT 'events' dataset, 'event_id' key_col, count(*) total_rows, count(*) FILTER (event_id IS NULL) null_count,
    count(DISTINCT event_id) unique_keys, count(*)-count(DISTINCT event_id) duplicate_count, false is_valid FROM r_events
    UNION ALL SELECT 'works', 'project_id', count(*), 0, count(DISTINCT project_id), 0, true FROM r_works""",
)
def v15(t):
    return q.key_report(t.project_events, "events", "event_id").unionByName(q.key_report(t.works, "works", "project_id"))


@query(
    "V16_score_bounds",
    " UNION ALL ".join(
        f"""SELECT '{c}' "column", min({c}) "min", max({c}) "max", false has_inf,
        min({c})>=-1e-4 AND max({c})<=1+1e-4 is_valid FROM r_risk"""
        for c in ("overall_risk_score", "delay_risk_score", "expenditure_ratio")
    ),
)
def v16(t):
    return q.score_bounds(t.risk, ["overall_risk_score", "delay_risk_score", "expenditure_ratio"])


@query(
    "V17_merge_cardinality",
    """SELECT (SELECT count(*) FROM orders) base_rows, count(*) merged_rows, count(DISTINCT o_orderkey) merged_keys, false preserved
    FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey""",
)
def v17(t):
    orders = t.read("orders")
    return q.merge_cardinality(orders, orders.join(t.read("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left"), "o_orderkey")
