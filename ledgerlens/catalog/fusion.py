"""Safe joins, signals, risk fusion, explanations; engine tables follow from the order keys."""

from pyspark.sql import functions as F

from ledgerlens.catalog.registry import R, cte, query
from ledgerlens.functions.numbers import rounded
from ledgerlens.operators import fusion
from ledgerlens.plans import risk as plan
from ledgerlens.schemas import RISK_COLUMNS


def N():
    return F.split_part("project_id", F.lit("|"), F.lit(1)).cast("long")


BASE = ["project_id", "mp_name", "state", "constituency", "category", "recommended_amount", "total_expenditure", "expenditure_ratio", "is_completed"]


def base(t):
    return t.risk.select(*BASE)


def engines(t):
    """Six engine results with gaps, each computed from the project's number."""
    b = base(t).withColumn("n", N())
    n = F.col("n")
    frac = lambda mul: (n * mul % 10001) / 10000.0
    # a result under another id is one that its project doesn't find
    known = lambda test: F.when(F.expr(test), F.col("project_id")).otherwise(F.concat("project_id", F.lit("|other"))).alias("project_id")
    return {
        "cost_anomaly": b.select(
            known("n % 10 <> 0"), frac(31).alias("cost_anomaly_score"), (n % 9 == 0).cast("int").alias("is_cost_anomaly"),
            F.when(n % 2 == 0, "EXPENDITURE_OVERRUN").otherwise("EXTREME_PEER_INFLATION").alias("cost_anomaly_type"),
            F.when(n % 3 != 0, (n % 700) / 100.0).alias("cost_z_score"), F.lit("ignored").alias("mp_name"),
        ),
        "delay_predictions": b.select(
            known("n % 11 <> 0"), frac(57).alias("delay_risk_score"), F.when(n % 8 == 0, "HIGH").otherwise("LOW").alias("delay_risk_level"),
            (n % 6 == 0).cast("int").alias("is_delayed_predicted"), (200 + n % 600).cast("double").alias("predicted_completion_days"),
        ),
        "isolation_forest": b.select(
            "project_id", frac(171).alias("anomaly_score"), (n % 20 == 0).cast("int").alias("is_anomaly"),
            F.when(n % 2 == 0, F.concat(F.lit("total_expenditure (+"), n % 90, F.lit(".0 sigma); payment_count (+2.0 sigma); days_since_recommendation (-1.5 sigma)"))).alias("top_anomaly_drivers"),
        ),
        "payment_anomaly": b.select(
            known("n % 4 <> 1"), frac(91).alias("payment_anomaly_score"), (n % 7 == 0).cast("int").alias("is_payment_anomaly"),
            F.lit("SEVERE_BUDGET_OVERRUN").alias("payment_anomaly_type"),
        ),
        "rule_flagged": b.select(
            known("n % 5 <> 0"), (n % 400).alias("rule_risk_score"), F.lit("HIGH_RISK").alias("risk_band"),
            F.lit("COMPLIANCE-001;GHOST-003").alias("rules_triggered"), (n % 3).alias("rule_count"), F.lit("why").alias("top_reasons"),
        ),
        "similarity_projects": b.select(
            known("n % 3 = 0"), frac(131).alias("max_similarity_score"), (n % 12).alias("duplicate_count"),
            (n % 13 == 0).cast("int").alias("exact_text_duplicate_flag"), (n % 6 == 0).cast("int").alias("high_text_similarity_flag"),
            rounded((n * 17 % 1000) / 10.0, 4).alias("duplicate_risk_score"),
        ),
    }


def fr(mul):
    return f"(n*{mul}%10001)/10000e0"


cte(
    "k_merged",
    f"""SELECT *, n%10<>0 has_cost, n%11<>0 has_delay, n%4<>1 has_pay, n%5<>0 has_rule, n%3=0 has_sim,
    CASE WHEN n%10<>0 THEN {fr(31)} END c_s, CASE WHEN n%11<>0 THEN {fr(57)} END d_s, CASE WHEN n%4<>1 THEN {fr(91)} END p_s,
    CASE WHEN n%5<>0 THEN least(1e0,(n%400)/300e0) END r_s, CASE WHEN n%3=0 THEN least(1e0,{R("(n*17%1000)/10e0", 4)}) END s_s, {fr(171)} i_s
    FROM (SELECT {", ".join(BASE)}, CAST(split_part(project_id,'|',1) AS BIGINT) n FROM r_risk)""",
)
cte(
    "k_sig",
    """SELECT *, has_cost AND (n%9=0 OR c_s>=0.6) c_f, has_delay AND (n%6=0 OR n%8=0) d_f, has_pay AND (n%7=0 OR p_s>=0.5) p_f, has_rule AND n%3>0 r_f,
    has_sim AND (n%13=0 OR n%6=0 OR s_s>=0.5) s_f, n%20=0 OR i_s>=0.5 i_f,
    0e0+(CASE WHEN has_cost THEN 0.2e0 ELSE 0 END)+(CASE WHEN has_delay THEN 0.2e0 ELSE 0 END)+(CASE WHEN has_pay THEN 0.2e0 ELSE 0 END)
    +(CASE WHEN has_rule THEN 0.2e0 ELSE 0 END)+(CASE WHEN has_sim THEN 0.1e0 ELSE 0 END)+0.1e0 w FROM k_merged""",
)
cte(
    "k_over",
    """SELECT *, least(1e0,greatest(0e0,0e0+coalesce(0.2e0/w*c_s,0e0)+coalesce(0.2e0/w*d_s,0e0)+coalesce(0.2e0/w*p_s,0e0)+coalesce(0.2e0/w*r_s,0e0)
    +coalesce(0.1e0/w*s_s,0e0)+coalesce(0.1e0/w*i_s,0e0))) o FROM k_sig""",
)


def f(x, d):
    return f"printf('%.{d}f'," + R(x, d) + ")"


SIGNALS = "list_sort(list_filter([" + ",".join(
    f"CASE WHEN {s} IS NOT NULL AND o>0 THEN struct_pack(m:=-({w}e0/w*{s}/o*100),i:={i},l:='{l}',s:={s}) END"
    for i, (l, s, w) in enumerate((("Cost", "c_s", 0.2), ("Delay", "d_s", 0.2), ("Payment", "p_s", 0.2), ("Rule", "r_s", 0.2),
                                   ("Similarity", "s_s", 0.1), ("Iforest", "i_s", 0.1)))
) + "], lambda x: x IS NOT NULL))[1:3]"
SIGNAL_TEXT = f"list_transform({SIGNALS}, lambda x: x.l||' (Score: '||{f('x.s', 2)}||', Weight: '||{f('-x.m', 1)}||'%)')"


def factors_sql(brief, shown=False):
    w = (("σ deviation)", "stall", "Payment Structuring", "Verbatim Duplicate Match", "Multivariate ML Outlier: High-dimensional deviation",
          "Nominal project execution: operational metrics within normal historical tolerances.")
         if brief else ("σ)", "delay", "Payment Anomaly", "Verbatim Text Match", "Multivariate ML Anomaly: High dimensional deviation",
                        "Nominal project indicators: execution within normal baseline variance."))
    sim = "s_s" if brief else fr(131)
    drivers = "'total_expenditure (+'||(n%90)||'.0 sigma); payment_count (+2.0 sigma); days_since_recommendation (-1.5 sigma)'"
    drivers = f"left({drivers},80)||'...'" if shown else drivers
    found = "list_filter([" + ",".join([
        f"CASE WHEN c_f OR c_s>=0.5 THEN 'Cost Anomaly: '||CASE WHEN n%2=0 THEN 'EXPENDITURE OVERRUN' ELSE 'EXTREME PEER INFLATION' END||CASE WHEN n%3<>0 THEN ' (+'||{f('(n%700)/100e0', 1)}||'{w[0]}' ELSE '' END||' (Score: '||{f('c_s', 2)}||')' END",
        f"CASE WHEN d_f OR d_s>=0.5 THEN 'Delay Risk: Forecasted project {w[1]} (~'||(200+n%600)||' days predicted) (Score: '||{f('d_s', 2)}||')' END",
        f"CASE WHEN p_f OR p_s>=0.5 THEN '{w[2]}: SEVERE BUDGET OVERRUN (Score: '||{f('p_s', 2)}||')' END",
        f"CASE WHEN r_f OR r_s>=0.3 THEN 'Rule Violations: COMPLIANCE-001;GHOST-003 ['||(n%3)||' triggered] (Score: '||{f('r_s', 2)}||')' END",
        f"CASE WHEN s_f OR s_s>=0.5 THEN 'Duplicate Work Alert: '||{f(sim, 2)}||' text similarity with '||(n%12)||' project(s)'||CASE WHEN n%13=0 THEN ' [{w[3]}]' ELSE '' END END",
        f"CASE WHEN i_f OR i_s>=0.5 THEN '{w[4]}'||CASE WHEN n%2=0 THEN ' [Drivers: '||{drivers}||']' ELSE '' END END",
    ]) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({found})>0 THEN {found} ELSE ['{w[5]}'] END"


cte(
    "k_fused",
    f"""SELECT *, {R("o", 4)} overall_risk_score, CASE WHEN o>=0.8 THEN 'CRITICAL' WHEN o>=0.6 THEN 'HIGH' WHEN o>=0.3 THEN 'MEDIUM' ELSE 'LOW' END risk_category,
    {SIGNAL_TEXT} sig, {factors_sql(False)} fac, {factors_sql(False, True)} fac_shown FROM k_over""",
)
EXPLAIN = f"""CASE WHEN o>=0.6 THEN 'Flagged as '||risk_category||' RISK (score '||{f("o", 2)}||'). Primary drivers: '||array_to_string(sig[1:2],'; ')||'.'
 WHEN o>=0.3 THEN 'Classified as '||risk_category||' RISK (score '||{f("o", 2)}||'). Moderate operational or financial friction observed.'
 ELSE 'Classified as LOW RISK (score '||{f("o", 2)}||'). Performance metrics within expected parameters.' END"""
FLAGS = {"cost": "c", "delay": "d", "payment": "p", "rule": "r", "similarity": "s", "iforest": "i"}
HAS = {"cost": "has_cost", "delay": "has_delay", "payment": "has_pay", "rule": "has_rule", "similarity": "has_sim", "iforest": "true"}


def fused(t):
    return plan.fused_features(base(t), engines(t))


@query(
    "J05_safe_left_join",
    "SELECT project_id, mp_name, CASE WHEN n%10<>0 THEN c_s END cost_anomaly_score, has_cost has_cost_anomaly FROM k_merged",
)
def j05(t):
    joined = fusion.safe_left_join(base(t), engines(t)["cost_anomaly"], "cost_anomaly", check=True)
    return joined.select("project_id", "mp_name", "cost_anomaly_score", "has_cost_anomaly")


MATCHED = [("cost_anomaly", "has_cost"), ("delay_predictions", "has_delay"), ("isolation_forest", "true"), ("payment_anomaly", "has_pay"),
           ("rule_flagged", "has_rule"), ("rule_aggregated_events", "false"), ("similarity_projects", "has_sim"), ("similarity_pair_aggregates", "false")]


@query(
    "J06_merge_all",
    " UNION ALL ".join(
        f"SELECT '{n}' feature, count(*) FILTER ({c}) matched_rows, count(*) FILTER (NOT {c}) unmatched_rows, {R(f'count(*) FILTER ({c})/CAST(count(*) AS DOUBLE)*100', 2)} coverage_pct FROM k_merged"
        for n, c in MATCHED
    ),
)
def j06(t):
    return fusion.match_report(fusion.merge_all(base(t), engines(t)))


for _i, _engine in enumerate(("cost", "delay", "payment", "rule", "similarity", "iforest")):

    def _signals(t, engine=_engine):
        merged = fusion.merge_all(base(t), engines(t))
        out = merged.withColumns(fusion.signal_columns(merged, engine))
        return out.select("project_id", f"{engine}_available", f"{engine}_risk_score", f"{engine}_risk_flag")

    query(
        f"I0{_i + 1}_{_engine}_signal",
        f"SELECT project_id, {HAS[_engine]} {_engine}_available, {FLAGS[_engine]}_s {_engine}_risk_score, {FLAGS[_engine]}_f {_engine}_risk_flag FROM k_sig",
    )(_signals)


POINTS = ",".join(
    f"coalesce({R(f'{R(s, 4)}*{R(f'{w}e0/w', 4)}*100', 2)},0e0)"
    for s, w in (("c_s", 0.2), ("d_s", 0.2), ("p_s", 0.2), ("r_s", 0.2), ("s_s", 0.1), ("i_s", 0.1))
)


@query(
    "I07_contributions",
    f"""SELECT project_id, total, abs(total-round_even(overall_risk_score*100,0))<=0.5 is_consistent, cost_points, n_points FROM (SELECT *, {R(f"list_sum([{POINTS}])", 2)} total,
    CASE WHEN has_cost THEN ([{POINTS}])[1] END cost_points, 1+has_cost::INT+has_delay::INT+has_pay::INT+has_rule::INT+has_sim::INT n_points FROM k_fused)""",
)
def i07(t):
    out = fusion.contributions(fused(t))
    return out.select(
        "project_id", "total", "is_consistent", F.element_at("points", "cost_risk").alias("cost_points"), F.size("points").alias("n_points")
    )


@query("I08_overall_score", "SELECT project_id, overall_risk_score FROM k_fused")
def i08(t):
    return fused(t).select("project_id", "overall_risk_score")


@query("I09_risk_category", "SELECT project_id, risk_category FROM k_fused")
def i09(t):
    return fused(t).select("project_id", "risk_category")


@query("I10_top_signals", "SELECT project_id, array_to_string(sig,'; ') top_risk_signals FROM k_fused")
def i10(t):
    return fused(t).select("project_id", "top_risk_signals")


@query("I11_risk_factors", "SELECT project_id, to_json(fac)::VARCHAR risk_factors, to_json(fac_shown)::VARCHAR risk_factors_shown FROM k_fused")
def i11(t):
    return fused(t).select("project_id", "risk_factors", "risk_factors_shown")


@query("I12_audit_explanation", f"SELECT project_id, {EXPLAIN} audit_explanation FROM k_fused")
def i12(t):
    return fused(t).select("project_id", "audit_explanation")


@query(
    "I13_evidence_payload",
    f"""SELECT project_id, overall_risk_score score, risk_category tier, {R("c_s", 4)} cost, {R("CASE WHEN has_sim THEN 0.1e0/w END", 4)} similarity_weight,
    fac[1] first_factor FROM k_fused""",
)
def i13(t):
    p = lambda path: F.get_json_object("evidence_payload", path)
    return fused(t).select(
        "project_id",
        p("$.overall_risk_score").cast("double").alias("score"),
        p("$.risk_category").alias("tier"),
        p("$.component_scores.cost_risk").cast("double").alias("cost"),
        p("$.active_weights.similarity_risk").cast("double").alias("similarity_weight"),
        p("$.risk_factors[0]").alias("first_factor"),
    )


FUSED_OUT = [c for c in RISK_COLUMNS if c != "evidence_payload"] + ["predicted_completion_days"]


@query(
    "I14_risk_results",
    f"""SELECT {", ".join(BASE)}, overall_risk_score, risk_category, {EXPLAIN} audit_explanation, array_to_string(sig,'; ') top_risk_signals,
    to_json(fac)::VARCHAR risk_factors, CASE WHEN has_delay THEN CAST(200+n%600 AS DOUBLE) END predicted_completion_days,
    {", ".join(f"{HAS[e]} {e}_available, {k}_s {e}_risk_score, {k}_f {e}_risk_flag" for e, k in FLAGS.items())} FROM k_fused""",
)
def i14(t):
    return plan.risk_results(fused(t)).select(*FUSED_OUT)


@query(
    "S08_run_report",
    f"""SELECT count(*) total_projects, count(*) final_project_count, count(*) unique_projects, true cardinality_preserved, 0::BIGINT duplicate_keys,
    {", ".join(f"count(*) FILTER ({c}) matched_{n}" for n, c in MATCHED)},
    {", ".join(f"count(*) FILTER (risk_category='{x}') {x.lower()}_count, {R(f"count(*) FILTER (risk_category='{x}')/CAST(count(*) AS DOUBLE)*100", 2)} {x.lower()}_pct" for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL"))}
    FROM k_fused""",
)
def s08(t):
    return plan.run_report(base(t), fused(t))


@query(
    "K03_reasons",
    f"""SELECT project_id, overall_risk_score, risk_category, CASE WHEN overall_risk_score>=0.6 THEN 'CRITICAL RISK: Severe financial, delay, or compliance anomalies detected. Immediate audit recommended.'
    WHEN overall_risk_score>=0.3 THEN 'MODERATE RISK: Notable operational friction or cost deviations observed. Priority monitoring advised.'
    ELSE 'LOW RISK: Project performance aligns with standard baseline execution.' END executive_summary, array_to_string({factors_sql(True)},' / ') factors FROM k_fused""",
)
def k03(t):
    out = fusion.executive_reasons(fused(t))
    return out.withColumn("factors", F.array_join("risk_factors", " / ")).drop("risk_factors")


@query(
    "K04_engine_breakdown",
    " UNION ALL ".join(
        f"SELECT project_id, '{title}' engine, {e}_risk_score score, {e}_risk_flag flag, {e}_available available FROM r_risk"
        for e, title in fusion.ENGINE_TITLES.items()
    ),
)
def k04(t):
    return fusion.engine_breakdown(t.risk)


# --- pairs ----------------------------------------------------------------------------------------

cte(
    "k_pairs",
    """SELECT CASE WHEN n%2=0 THEN a ELSE b END project_id_a, CASE WHEN n%2=0 THEN b ELSE a END project_id_b, 0.8e0+(n%20)/100e0 similarity_score, (n%7)/10e0 pair_risk_score,
    CAST(n%5=0 AS INT) exact_text_duplicate_flag, ['CRITICAL_GEO','HIGH_GEO','MEDIUM_GEO'][n%3+1] geo_risk_label, ['SAME_CONSTITUENCY','SAME_STATE_DIFF_CONST','DIFF_STATE','UNKNOWN'][n%4+1] geo_relationship,
    1+(n%12) cost_ratio, n%6=0 is_generic_a, n%8=0 is_generic_b, 'MP '||(n%3) mp_a, 'MP '||(n%2) mp_b,
    ['NORMAL_COST','HIGH_BUDGET_INFLATION','CRITICAL_BUDGET_INFLATION','NOT_CHECKED'][n%4+1] budget_anomaly_label
    FROM (SELECT 'P'||l_suppkey a, 'P'||(l_partkey%50) b, l_orderkey n FROM lineitem WHERE l_suppkey<>l_partkey%50)""",
)


def pair_rows(t):
    n, even = F.col("l_orderkey"), F.col("l_orderkey") % 2 == 0
    a, b = F.concat(F.lit("P"), "l_suppkey"), F.concat(F.lit("P"), F.col("l_partkey") % 50)
    pick = lambda xs, m: F.element_at(F.array(*map(F.lit, xs)), (n % m + 1).cast("int"))
    return t.read("lineitem").filter("l_suppkey <> l_partkey % 50").select(
        F.when(even, a).otherwise(b).alias("project_id_a"), F.when(even, b).otherwise(a).alias("project_id_b"),
        (0.8 + (n % 20) / 100.0).alias("similarity_score"), ((n % 7) / 10.0).alias("pair_risk_score"),
        (n % 5 == 0).cast("int").alias("exact_text_duplicate_flag"),
        pick(["CRITICAL_GEO", "HIGH_GEO", "MEDIUM_GEO"], 3).alias("geo_risk_label"),
        pick(["SAME_CONSTITUENCY", "SAME_STATE_DIFF_CONST", "DIFF_STATE", "UNKNOWN"], 4).alias("geo_relationship"),
        (1 + n % 12).cast("double").alias("cost_ratio"), (n % 6 == 0).alias("is_generic_a"), (n % 8 == 0).alias("is_generic_b"),
        F.concat(F.lit("MP "), n % 3).alias("mp_a"), F.concat(F.lit("MP "), n % 2).alias("mp_b"),
        pick(["NORMAL_COST", "HIGH_BUDGET_INFLATION", "CRITICAL_BUDGET_INFLATION", "NOT_CHECKED"], 4).alias("budget_anomaly_label"),
    )


@query(
    "A09_pair_aggregate",
    """SELECT project_id, count(*) pair_duplicate_count, max(similarity_score) max_pair_similarity_score, max(pair_risk_score) max_pair_risk_score, max(exact_text_duplicate_flag) pair_exact_text_flag,
    max(CAST(geo_risk_label='CRITICAL_GEO' AS INT)) pair_critical_geo_flag FROM (SELECT *, unnest([project_id_a,project_id_b]) project_id FROM k_pairs) GROUP BY 1""",
)
def a09(t):
    return fusion.aggregate_pairs(pair_rows(t))


@query(
    "A10_project_similarity_features",
    f"""SELECT project_id, coalesce(s,0) max_similarity_score, coalesce(c,0) duplicate_count, coalesce(CAST(s>=0.97 AS BIGINT),0) exact_text_duplicate_flag, coalesce(CAST(s>=0.85 AS BIGINT),0) high_text_similarity_flag,
    coalesce(x,0) cross_mp_duplicate_flag, coalesce(r,0) max_cost_ratio, coalesce(b,0) budget_inflation_flag,
    {R("least(100e0,coalesce(s,0)*50+least(coalesce(c,0),10)/10e0*15+coalesce(x,0)*15+coalesce(g,0)*10+coalesce(b,0)*10)", 4)} duplicate_risk_score
    FROM (SELECT 'P'||s_suppkey project_id FROM supplier UNION SELECT project_id_a FROM k_pairs UNION SELECT project_id_b FROM k_pairs) LEFT JOIN (SELECT project_id, max(sim) s, count(*) c, max(x) x, max(r) r, max(b) b, max(g) g FROM (
    SELECT unnest([lo,hi]) project_id, * FROM (SELECT lo, hi, p.sim sim, p.x x, p.r r, p.b b, p.g g FROM (SELECT lo, hi, first(struct_pack(sim,r,gen,x,place,b,g) ORDER BY sim,r,gen,x,place,b) p FROM (SELECT least(project_id_a,project_id_b) lo, greatest(project_id_a,project_id_b) hi,
    similarity_score sim, CAST(cost_ratio AS DOUBLE) r, is_generic_a OR is_generic_b gen, CAST(mp_a<>mp_b AS BIGINT) x, geo_relationship place, CAST(budget_anomaly_label LIKE '%INFLATION' AS BIGINT) b,
    CASE geo_relationship WHEN 'SAME_CONSTITUENCY' THEN 1e0 WHEN 'SAME_STATE_DIFF_CONST' THEN 0.7e0 WHEN 'DIFF_STATE' THEN 0.4e0 ELSE 0e0 END g FROM k_pairs) GROUP BY ALL))) GROUP BY 1) USING (project_id)""",
)
def a10(t):
    ids = t.read("supplier").select(F.concat(F.lit("P"), "s_suppkey").alias("project_id"))
    return fusion.project_similarity_features(pair_rows(t), ids).select(
        "project_id", "max_similarity_score", "duplicate_count", "exact_text_duplicate_flag", "high_text_similarity_flag",
        "cross_mp_duplicate_flag", "max_cost_ratio", "budget_inflation_flag", "duplicate_risk_score",
    )
