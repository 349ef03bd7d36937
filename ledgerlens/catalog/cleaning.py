"""Sources, sinks, cleaning projections and scalar functions."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.catalog.registry import R, cte, query
from ledgerlens.functions import dates, numbers, text
from ledgerlens.operators.cleaning import clean_table
from ledgerlens.schemas import RAW_COLUMNS
from ledgerlens.session import scratch_path
from ledgerlens.sources import files
from ledgerlens.sources.testtables import AS_OF


def N():
    return F.col("o_orderkey")


def pick(*options):
    """Option ``o_orderkey % len``."""
    return F.element_at(F.array(*options), (N() % len(options) + 1).cast("int"))


def messy(t):
    """Orders as hand-typed text, with the usual defects."""
    price, day = F.col("o_totalprice").cast("string"), F.col("o_orderdate").cast("timestamp")
    fmt = lambda p: F.date_format(day, p)
    none = F.lit(None).cast("string")
    return t.read("orders").select(
        "o_orderkey",
        pick(
            F.concat(F.lit("₹ "), price), F.concat(F.lit("Rs"), price), F.concat(F.lit("("), price, F.lit(")")),
            F.concat(F.lit("about "), price, F.lit(" lakh")), F.lit("n/a"), F.lit(" "), none,
        ).alias("amount"),
        pick(
            fmt("yyyy-MM-dd"), fmt("dd-MM-yyyy"), fmt("dd/MM/yyyy"), fmt("yyyy/MM/dd"), fmt("yyyyMMdd"),
            F.concat(fmt("yyyy-MM-dd"), F.lit("T10:00:00")), F.lit("N/A"), F.lit("2001-02-30"), none, fmt("d MMM yyyy"), fmt("MMMM d, yyyy"),
        ).alias("day"),
        pick(F.lit(" Yes"), F.lit("0"), F.lit("FALSE"), F.lit("maybe"), F.lit(" "), none, F.lit("1")).alias("flag"),
        pick(
            F.lit("Payment In-Progress"), F.lit(" payment success "), F.lit("PAID"), F.lit("Payment Completed"),
            F.lit("in progress"), F.lit(""), none,
        ).alias("status"),
        F.concat(F.lit("  Road\t of "), F.col("o_orderpriority"), F.lit("  (Ward #"), N() % 9, F.lit(") ")).alias("title"),
    )


cte(
    "m_orders",
    """SELECT o_orderkey, [ '₹ '||o_totalprice, 'Rs'||o_totalprice, '('||o_totalprice||')', 'about '||o_totalprice||' lakh',
       'n/a', ' ', NULL ][o_orderkey%7+1] amount,
       [ strftime(o_orderdate,'%Y-%m-%d'), strftime(o_orderdate,'%d-%m-%Y'), strftime(o_orderdate,'%d/%m/%Y'),
         strftime(o_orderdate,'%Y/%m/%d'), strftime(o_orderdate,'%Y%m%d'), strftime(o_orderdate,'%Y-%m-%d')||'T10:00:00',
         'N/A', '2001-02-30', NULL, strftime(o_orderdate,'%-d %b %Y'), strftime(o_orderdate,'%B %-d, %Y') ][o_orderkey%11+1] AS "day",
       [' Yes','0','FALSE','maybe',' ',NULL,'1'][o_orderkey%7+1] flag,
       ['Payment In-Progress',' payment success ','PAID','Payment Completed','in progress','',NULL][o_orderkey%7+1] status,
       '  Road'||chr(9)||' of '||o_orderpriority||'  (Ward #'||(o_orderkey%9)||') ' title FROM orders""",
)
AMOUNT = r"""coalesce(TRY_CAST({0} AS DOUBLE), TRY_CAST(nullif(regexp_extract({0},'-?\d+(?:\.\d+)?'),'') AS DOUBLE))""".format(
    "replace(replace(regexp_replace(trim(amount),'₹|Rs|INR|,| ','','g'),'(','-'),')','')"
)
STRICT = """coalesce(try_strptime({0},'%Y-%m-%d'),try_strptime({0},'%d-%m-%Y'),try_strptime({0},'%d/%m/%Y'),
  try_strptime({0},'%Y/%m/%d'),try_strptime({0},'%Y%m%d'))"""

# month first where both readings are possible
LENIENT = ["%Y-%m-%d", "%Y/%m/%d", "%Y%m%d", "%m/%d/%Y", "%m-%d-%Y", "%d/%m/%Y", "%d-%m-%Y", "%d %b %Y", "%B %d, %Y"]


def raw_works(t):
    """Works with raw headers, everything text, and exact repeats."""
    w = t.works
    headers = {v: k.title() for k, v in RAW_COLUMNS["recommended_works"].items()}
    headers["recommended_amount"] = "Recommended  Amount (₹)"
    raw = w.select(
        F.col("work_id"),
        F.concat(F.lit(" "), F.col("work_description"), F.lit("  x")).alias("work_description"),
        *[F.col(c) for c in ("category", "mp_name", "constituency", "state", "house")],
        F.concat(F.lit("Rs "), F.col("recommended_amount").cast("string")).alias("recommended_amount"),
        F.date_format("recommendation_date", "dd-MM-yyyy").alias("recommendation_date"),
        F.when(F.col("has_images"), "Yes").otherwise("No").alias("has_images"),
        "ida",
    )
    raw = raw.unionByName(raw.filter(F.col("work_id").cast("long") % 5 == 0))
    return raw.select(*[F.col(c).alias(headers[c]) for c in raw.columns])


@query(
    "S01_read_raw_csv",
    """SELECT work_id, trim(work_description)||' x' work_description, coalesce(category,'') category, mp_name, constituency,
    state, house, recommended_amount, CAST(recommendation_date AS DATE) recommendation_date, has_images, ida
    FROM r_works""",
)
def s01(t):
    path = scratch_path(t.spark, "raw-works")
    raw_works(t).write.csv(path, header=True)
    amount = [c for c in files.read_raw_csv(t.spark, path, "recommended_works").columns if c.startswith("recommended amount")]
    raw = files.read_raw_csv(t.spark, path, "recommended_works")
    for c in amount:
        raw = raw.withColumnRenamed(c, "recommended_amount")
    clean = clean_table(raw, "recommended_works", day_first=True)  # as raw_works writes them
    return clean.withColumn("recommendation_date", F.col("recommendation_date").cast("date"))


@query(
    "S02_load_registry",
    """SELECT 'base_projects' dataset, true loaded, count(*) row_count FROM r_risk
    UNION ALL SELECT 'agency_profiles', false, 0""",
)
def s02(t):
    base = scratch_path(t.spark, "registry")
    t.risk.write.parquet(f"{base}/base")
    registry = files.DatasetRegistry(t.spark, base, {"base_projects": "base"})
    return files.load_report({k: registry.load_table(k) for k in ("base_projects", "agency_profiles")})


@query("S03_gzip_csv", "SELECT project_id, state, overall_risk_score FROM r_risk")
def s03(t):
    path = scratch_path(t.spark, "risk")
    df = t.risk.select("project_id", "state", "overall_risk_score")
    df.write.option("compression", "gzip").csv(f"{path}.csv.gz", header=True)
    return files.read_csv_or_gzip(t.spark, f"{path}.csv", df.schema)


@query("S04_pruned_read", "SELECT o_orderkey, o_totalprice FROM orders")
def s04(t):
    return files.read_columns(t.read("orders"), ["o_orderkey", "o_totalprice"])


@query(
    "S05_event_log",
    """SELECT event_id, event_type, event_timestamp, project_id, mp_name, expenditure_amount, payment_status FROM r_events
    WHERE event_type='PAYMENT_RECEIVED'""",
)
def s05(t):
    path = scratch_path(t.spark, "events")
    good = t.project_events.select(F.to_json(F.struct("*")).alias("value"), "seq")
    broken = good.filter("seq % 10 = 0").select(F.concat(F.lit("{broken"), "seq").alias("value"))
    good.select("value").unionByName(broken).unionByName(broken.select(F.lit("  ").alias("value"))).write.text(path)
    log = files.event_history(files.read_event_log(t.spark, path), event_type="PAYMENT_RECEIVED")
    return log.select(
        "event_id", "event_type", "event_timestamp", "project_id", "mp_name", "expenditure_amount", "payment_status"
    )


@query("S06_result_sink", "SELECT work_id, reasons FROM (SELECT work_id, to_json(reasons)::VARCHAR reasons FROM r_votes)")
def s06(t):
    path = scratch_path(t.spark, "votes")
    tags = F.from_json("reasons", "array<string>")
    files.write_table(t.vote_actions.select("work_id", tags.alias("reasons")), path, "csv")
    return t.spark.read.csv(path, header=True, schema="work_id string, reasons string", escape="\\", quote='"')


@query("C01_normalize_text", r"SELECT o_orderkey, trim(regexp_replace(title,'\s+',' ','g')) title FROM m_orders")
def c01(t):
    return messy(t).select("o_orderkey", text.normalize_text(F.col("title")).alias("title"))


@query(
    "C02_normalize_description",
    "SELECT doc_id, trim(regexp_replace(lower(text),'[^a-z0-9]+',' ','g')) description FROM documents",
)
def c02(t):
    return t.read("documents").select("doc_id", text.normalize_description(F.col("text")).alias("description"))


@query("C03_parse_amount", f"SELECT o_orderkey, {AMOUNT} amount FROM m_orders")
def c03(t):
    return messy(t).select("o_orderkey", numbers.parse_amount(F.col("amount")).alias("amount"))


@query(
    "C04_parse_date",
    f"""SELECT o_orderkey, CAST(coalesce(TRY_CAST("day" AS TIMESTAMP), {", ".join(f"try_strptime(day,'{x}')" for x in LENIENT)}) AS VARCHAR) AS "day" FROM m_orders""",
)
def c04(t):
    lenient = dates.parse_date(F.col("day"))
    return messy(t).select("o_orderkey", F.date_format(lenient, "yyyy-MM-dd HH:mm:ss").alias("day"))


@query("C05_strict_date", f"""SELECT o_orderkey, CAST({STRICT.format("split_part(split_part(trim(day),'T',1),' ',1)")} AS DATE) AS "day" FROM m_orders""")
def c05(t):
    return messy(t).select("o_orderkey", dates.strict_date(F.col("day")).alias("day"))


@query(
    "C06_parse_bool",
    """SELECT o_orderkey, CASE WHEN flag IS NULL THEN false WHEN lower(trim(flag)) IN ('1','true','yes','y') THEN true
    WHEN lower(trim(flag)) IN ('0','false','no','n') THEN false ELSE trim(flag)<>'' END flag FROM m_orders""",
)
def c06(t):
    return messy(t).select("o_orderkey", dates.parse_bool(F.col("flag")).alias("flag"))


@query(
    "C07_iso_utc",
    """SELECT event_id, CASE event_id%4 WHEN 3 THEN NULL WHEN 1 THEN strftime(ts - INTERVAL 330 MINUTE,'%Y-%m-%dT%H:%M:%SZ')
    ELSE strftime(ts,'%Y-%m-%dT%H:%M:%SZ') END iso FROM events""",
)
def c07(t):
    ts, n = F.col("ts").cast("timestamp"), F.col("event_id")
    stamp = (
        F.when(n % 4 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when(n % 4 == 1, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("+05:30")))
        .when(n % 4 == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .otherwise("soon")
    )
    return t.read("events").select("event_id", dates.iso_utc(stamp).alias("iso"))


@query(
    "C08_batch_status",
    """SELECT o_orderkey, CASE lower(trim(status)) WHEN 'payment in-progress' THEN 'payment_in_progress' WHEN 'in progress' THEN
    'in_progress' WHEN 'payment completed' THEN 'payment_completed' ELSE lower(trim(status)) END status FROM m_orders""",
)
def c08(t):
    return messy(t).select("o_orderkey", text.batch_payment_status(F.col("status")).alias("status"))


@query(
    "C09_stream_status",
    """SELECT o_orderkey, CASE WHEN trim(status)='' THEN NULL WHEN lower(trim(status))='payment success' THEN 'successful'
    WHEN lower(trim(status))='payment in-progress' THEN 'payment_in_progress' ELSE lower(trim(status)) END status,
    trim(status) status_raw FROM m_orders""",
)
def c09(t):
    s = F.col("status")
    return messy(t).select("o_orderkey", text.stream_payment_status(s).alias("status"), F.trim(s).alias("status_raw"))


@query(
    "C10_safe_numbers",
    """SELECT o_orderkey, coalesce(v,-1) as_float, coalesce(CAST(trunc(v) AS BIGINT),7) as_int FROM (SELECT o_orderkey,
    TRY_CAST(replace(trim(replace(coalesce(amount,'x'),'Rs','1,')),',','') AS DOUBLE) v FROM m_orders)""",
)
def c10(t):
    v = F.replace(F.coalesce("amount", F.lit("x")), F.lit("Rs"), F.lit("1,"))
    return messy(t).select(
        "o_orderkey", numbers.safe_float(v, -1.0).alias("as_float"), numbers.safe_int(v, 7).alias("as_int")
    )


@query(
    "C11_finite",
    """SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_discount<>0 THEN l_quantity/l_discount END ratio,
    CASE WHEN l_discount<>0 THEN l_quantity/l_discount ELSE 0 END ratio_or_zero FROM lineitem""",
)
def c11(t):
    d = F.col("l_discount")
    raw = F.when(d == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("l_quantity"), d))
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", numbers.finite(raw).alias("ratio"),
        numbers.finite(raw, 0.0).alias("ratio_or_zero"),
    )


@query(
    "C12_ratio",
    "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_discount=0 THEN 0 ELSE l_tax/l_discount END ratio FROM lineitem",
)
def c12(t):
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", numbers.ratio(F.col("l_tax"), F.col("l_discount")).alias("ratio")
    )


@query(
    "C13_elapsed_days",
    "SELECT project_id, date_diff('day',CAST(recommendation_date AS DATE),DATE '2002-01-01') AS days FROM r_works",
)
def c13(t):
    return t.works.select("project_id", dates.elapsed_days(F.col("recommendation_date"), F.lit(AS_OF)).alias("days"))


@query(
    "C14_thresholds",
    """SELECT project_id, coalesce(recommended_amount>250000,false) gt, coalesce(recommended_amount<=250000,false) lte,
    coalesce(recommended_amount<>1,false) ne, false unknown FROM r_works""",
)
def c14(t):
    a = F.col("recommended_amount")
    return t.works.select(
        "project_id",
        numbers.threshold(a, "gt", 250000).alias("gt"),
        numbers.threshold(a, "<=", 250000).alias("lte"),
        numbers.threshold(a, "ne", 1).alias("ne"),
        numbers.threshold(a, "between", 1).alias("unknown"),
    )


@query(
    "C15_severity_score",
    """SELECT project_id, CASE WHEN is_completed=1 THEN CASE risk_category WHEN 'LOW' THEN 20 WHEN 'MEDIUM' THEN 40
    WHEN 'HIGH' THEN 70 WHEN 'CRITICAL' THEN 90 ELSE 20 END ELSE 0 END::BIGINT score FROM r_risk""",
)
def c15(t):
    score = numbers.severity_score(F.lower("risk_category"), F.col("is_completed") == 1)
    return t.risk.select("project_id", score.alias("score"))


@query(
    "C16_project_key",
    """SELECT project_id, split_part(project_id,'|',1) short_id, trim(split_part(project_id,'|',2)) mp,
    concat_ws('|',work_id,mp_name,constituency,state) rebuilt FROM r_works""",
)
def c16(t):
    pid = F.col("project_id")
    return t.works.select(
        pid,
        text.key_part(pid, 1).alias("short_id"),
        text.key_part(pid, 2).alias("mp"),
        text.project_key(*[F.col(c) for c in ("work_id", "mp_name", "constituency", "state")]).alias("rebuilt"),
    )


@query(
    "C17_format_inr",
    f"""SELECT project_id, CASE WHEN v IS NULL THEN 'N/A' WHEN v>=1e7 THEN '₹'||printf('%.2f',{R('v/1e7', 2)})||' Cr'
    WHEN v>=1e5 THEN '₹'||printf('%.2f',{R('v/1e5', 2)})||' Lakh' ELSE '₹'||format('{{:,.0f}}',v) END inr FROM
    (SELECT project_id, round_even(recommended_amount,0)*CASE WHEN CAST(work_id AS BIGINT)%3=0 THEN 1000e0 ELSE 1e0 END v FROM r_works)""",
)
def c17(t):
    v = F.rint("recommended_amount") * F.when(F.col("work_id").cast("long") % 3 == 0, 1000.0).otherwise(1.0)
    return t.works.select("project_id", numbers.format_inr(v).alias("inr"))


@query(
    "C18_fingerprint",
    """SELECT l_orderkey, l_linenumber, fp, 'hist-'||replace(replace('A|'||l_orderkey||' x','|','-'),' ','_')||'-payment_received-'||fp event_id
    FROM (SELECT *, substr(sha256('{"line":"'||l_linenumber||'","order":"'||l_orderkey||'","qty":"'||l_quantity||'"}'),1,20) fp FROM lineitem)""",
)
def c18(t):
    fp = text.fingerprint({"qty": F.col("l_quantity"), "order": F.col("l_orderkey"), "line": F.col("l_linenumber")})
    project = F.concat(F.lit("A|"), F.col("l_orderkey"), F.lit(" x"))
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", fp.alias("fp"),
        text.event_id("hist", project, F.lit("PAYMENT_RECEIVED"), fp).alias("event_id"),
    )


@query(
    "C19_hash_identity",
    "SELECT c_custkey, h, 'CIT-XXXX XXXX '||right(h,4) masked FROM (SELECT c_custkey, sha256('civic:'||trim(c_name)) h FROM customer)",
)
def c19(t):
    h = text.hash_identity(F.col("c_name"), "civic")
    return t.read("customer").select("c_custkey", h.alias("h"), text.mask_identity(h).alias("masked"))


@query(
    "C20_location_markers",
    f"SELECT regexp_matches(lower(text),'{text.LOCATION_MARKERS}') has_location, count(*) works FROM documents GROUP BY 1",
)
def c20(t):
    flag = text.has_location_marker(F.col("text")).alias("has_location")
    return t.read("documents").groupBy(flag).agg(F.count("*").alias("works"))


@query("C21_display_score", "SELECT project_id, CAST(round_even(overall_risk_score*100,0) AS BIGINT) score FROM r_risk")
def c21(t):
    return t.risk.select("project_id", numbers.display_score(F.col("overall_risk_score")).alias("score"))


@query(
    "C22_category_code",
    """SELECT o_orderkey, CASE c WHEN 'Repair and Renovation' THEN 1 WHEN 'Trust and Society' THEN 2 WHEN 'Bar and Associations'
    THEN 3 ELSE 0 END code, CAST(o_orderkey%2=0 AS INT) images FROM (SELECT o_orderkey, ['Normal/Others','Repair and Renovation',
    'Trust and Society','Bar and Associations','Unheard of',NULL][o_orderkey%6+1] c FROM orders)""",
)
def c22(t):
    c = pick(*[F.lit(x) for x in list(text.CATEGORY_CODES) + ["Unheard of", None]])
    return t.read("orders").select(
        "o_orderkey", text.category_code(c).alias("code"), (N() % 2 == 0).cast("int").alias("images")
    )
