"""Scaling, isolation forest, cost and delay detectors.  Score formulas are checked with the model output as an input column."""

from pyspark.sql import functions as F

from ledgerlens.catalog.master import features_of
from ledgerlens.catalog.registry import MED, R, SIG, cte, query
from ledgerlens.catalog.scoring import payment_input
from ledgerlens.functions.numbers import rounded
from ledgerlens.operators import cost, delay, features, iforest, payments, rules
from ledgerlens.operators.scaling import fit_scaling, top_drivers
from ledgerlens.plans import engines
from ledgerlens.session import materialize


def N():
    return F.split_part("project_id", F.lit("|"), F.lit(1)).cast("long")


SCALED = ["recommended_amount", "total_expenditure", "expenditure_ratio", "cost_deviation_from_peer", "payment_count", "days_since_recommendation"]


def scored_features(t):
    """Features with a similarity score that follows from the key."""
    return features_of(t).withColumn("description_similarity_score", (N() % 100) / 100.0)


cte("d_med", "SELECT " + ", ".join(f"{MED(f'CAST({c} AS DOUBLE)')} m_{c}" for c in SCALED) + " FROM k_feat")
cte("d_fill", "SELECT project_id, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE),m_{c}) {c}, CAST({c} AS DOUBLE) raw_{c}" for c in SCALED) + " FROM k_feat, d_med")
cte(
    "d_fit",
    "SELECT " + ", ".join(
        f"quantile_cont({c},0.25) a_{c}, {MED(c)} c_{c}, quantile_cont({c},0.75) b_{c}, avg({c}) m_{c}, CASE WHEN stddev_pop({c})>1e-6 THEN stddev_pop({c}) ELSE 1e0 END s_{c}" for c in SCALED
    ) + " FROM d_fill",
)


@query(
    "D01_robust_scaling",
    "SELECT project_id, " + ", ".join(R(f"({c}-c_{c})/(CASE WHEN b_{c}>a_{c} THEN b_{c}-a_{c} ELSE 1e0 END)", 6) + f" {c}" for c in SCALED) + " FROM d_fill, d_fit",
)
def d01(t):
    df = materialize(features_of(t))
    scaling = fit_scaling(df, SCALED)
    return df.select("project_id", *[rounded(scaling.scaled(c), 6).alias(c) for c in SCALED])


Z = {c: f"(raw_{c}-m_{c})/s_{c}" for c in SCALED}
DRIVERS = "list_sort(list_filter([" + ",".join(
    f"CASE WHEN raw_{c} IS NOT NULL THEN struct_pack(m:=-abs({Z[c]}),i:={i},f:='{c}',z:={Z[c]}) END" for i, c in enumerate(SCALED)
) + "], lambda x: x IS NOT NULL))[1:3]"


@query(
    "D04_anomaly_drivers",
    f"""SELECT project_id, array_to_string(list_transform({DRIVERS}, lambda e: e.f||' ('||CASE WHEN e.z>=0 THEN '+' ELSE '' END||printf('%.1f',{R("e.z", 1)})||' sigma)'),'; ') drivers FROM d_fill, d_fit""",
)
def d04(t):
    df = materialize(features_of(t))
    return df.select("project_id", top_drivers(fit_scaling(df, SCALED)).alias("drivers"))


def forest_of(t, trees=50):
    df = materialize(scored_features(t).select("project_id", *iforest.FEATURES))
    return df, iforest.fit_forest(df, trees=trees)


@query("D02_isolation_forest_fit")
def d02(t):
    _, forest = forest_of(t)
    nodes = t.spark.createDataFrame(forest.nodes)
    return nodes.groupBy("tree").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"), F.sum(F.when(F.col("feature") < 0, F.col("size"))).alias("rows"))


@query("D02_tree_samples", "SELECT CAST(t AS INT) tree, least(256, (SELECT count(*) FROM k_feat)) AS rows FROM range(50) r(t)")
def d02_samples(t):
    _, forest = forest_of(t)
    leaves = t.spark.createDataFrame(forest.nodes).filter("feature < 0")
    return leaves.groupBy("tree").agg(F.sum("size").cast("long").alias("rows"))


@query("D03_isolation_scores")
def d03(t):
    df, forest = forest_of(t)
    return iforest.score_forest(df, forest)


@query("D05_local_density")
def d05(t):
    df = materialize(features_of(t))
    scaling = fit_scaling(df, cost.FEATURES)
    raw = materialize(cost.density_scores(df.select("project_id", *cost.FEATURES), scaling), "density")
    return cost.scaled_density(raw).select("project_id", rounded(F.col("density_raw"), 4).alias("density_raw"), rounded(F.col("density"), 4).alias("density"))


# --- cost -----------------------------------------------------------------------------------------

DEV, RATIO, SPENT = "cost_deviation_from_peer", "expenditure_ratio", "total_expenditure"
cte(
    "d_cost",
    f"""SELECT *, {SIG(DEV, 0.015, 150.0)} peer_r, CASE WHEN {SPENT}>0 THEN least(1e0,greatest(0e0,({RATIO}-1)/2)) ELSE 0e0 END over_r, {SIG("z", 1.0, 2.5)} z_r,
    (CAST(split_part(project_id,'|',1) AS BIGINT)%100)/100e0 dens, (CAST(split_part(project_id,'|',1) AS BIGINT)%100)/100e0 sim
    FROM (SELECT d.*, (d.recommended_amount-coalesce(peer_mean_cost,d.recommended_amount))/(CASE WHEN peer_std_cost>=1 THEN peer_std_cost ELSE 1e0 END) z FROM d_fill d JOIN k_feat USING (project_id))""",
)
COMP = f"CASE WHEN {RATIO}>1.5 AND {SPENT}>0 THEN greatest(0.88e0,least(1e0,0.65e0*greatest(peer_r,over_r*1.2e0,z_r)+0.35e0*dens)) ELSE least(1e0,0.65e0*greatest(peer_r,over_r*1.2e0,z_r)+0.35e0*dens) END"
TYPE = f"""coalesce(nullif(concat_ws('|',CASE WHEN {RATIO}>1.05 AND {SPENT}>0 THEN CASE WHEN {RATIO}>2 THEN 'SEVERE_EXPENDITURE_OVERRUN' ELSE 'EXPENDITURE_OVERRUN' END END,
 CASE WHEN {DEV}>=500 OR z>=3.5 THEN 'EXTREME_PEER_INFLATION' WHEN {DEV}>=200 OR z>=2 THEN 'MODERATE_PEER_INFLATION' END, CASE WHEN sim>=0.85 AND {DEV}>=300 THEN 'BOILERPLATE_COST_INFLATION' END,
 CASE WHEN {DEV}<=-95 THEN 'IMPLAUSIBLE_UNDERCOST' END),''),'NORMAL')"""


def filled(t):
    df = materialize(scored_features(t))
    scaling = fit_scaling(df, SCALED)
    return df.withColumns({c: scaling.filled(c) for c in SCALED})


def z_of():
    return cost.peer_z_score(F.col("recommended_amount"), F.col("peer_mean_cost"), F.col("peer_std_cost"))


@query("D06_peer_risk", f"SELECT project_id, {R('peer_r', 6)} peer_risk FROM d_cost")
def d06(t):
    return filled(t).select("project_id", rounded(cost.peer_risk(F.col(DEV)), 6).alias("peer_risk"))


@query("D07_overrun_risk", f"SELECT project_id, {R('over_r', 6)} overrun_risk FROM d_cost")
def d07(t):
    return filled(t).select("project_id", rounded(cost.overrun_risk(F.col(RATIO), F.col(SPENT)), 6).alias("overrun_risk"))


@query("D08_peer_z_score", f"SELECT project_id, {R('z', 4)} z, {R('z_r', 6)} z_risk FROM d_cost")
def d08(t):
    return filled(t).select("project_id", rounded(z_of(), 4).alias("z"), rounded(cost.z_risk(z_of()), 6).alias("z_risk"))


@query("D09_cost_composite", f"SELECT project_id, {R(COMP, 4)} score, CAST(({COMP})>=0.5 AS INT) flag FROM d_cost")
def d09(t):
    ratio, spent = F.col(RATIO), F.col(SPENT)
    parts = (cost.peer_risk(F.col(DEV)), cost.overrun_risk(ratio, spent), cost.z_risk(z_of()), (N() % 100) / 100.0)
    score = cost.cost_composite(*parts, ratio, spent)
    return filled(t).select("project_id", rounded(score, 4).alias("score"), (score >= 0.5).cast("int").alias("flag"))


@query("D10_cost_typology", f"SELECT project_id, {TYPE} cost_anomaly_type FROM d_cost")
def d10(t):
    kind = cost.cost_typology(F.col(DEV), F.col(RATIO), F.col(SPENT), F.col("description_similarity_score"), z_of())
    return filled(t).select("project_id", kind.alias("cost_anomaly_type"))


@query("D11_cost_detector")
def d11(t):
    return cost.detect_cost_anomalies(materialize(scored_features(t)))


# --- delay ----------------------------------------------------------------------------------------

cte(
    "d_feat",
    """SELECT project_id, recommended_amount, 0 category_code, payment_count, pending_payment_count, CAST(has_images AS INT) has_images_code, completion_rate_pct, utilization_pct,
    recommended_works-completed_works completion_gap FROM k_feat LEFT JOIN (SELECT mp_name, completion_rate_pct, utilization_pct, recommended_works, completed_works FROM r_mp) USING (mp_name)""",
)


def mp_of(t):
    return features.create_mp_features(t.mp_summary)


@query(
    "D12_delay_features",
    "SELECT project_id, recommended_amount, category_code, CAST(payment_count AS DOUBLE) payment_count, CAST(pending_payment_count AS DOUBLE) pending_payment_count, has_images_code, completion_rate_pct, utilization_pct, CAST(completion_gap AS DOUBLE) completion_gap FROM d_feat",
)
def d12(t):
    return delay.delay_features(features_of(t), mp_of(t)).select("project_id", *delay.FEATURES)


PRED = "CAST(60+CAST(split_part(project_id,'|',1) AS BIGINT)%1300 AS DOUBLE)"
cte(
    "d_delay",
    f"""SELECT *, least(1e0,greatest(0e0,CASE WHEN is_completed=1 THEN CASE WHEN took>pdays THEN least(1e0,(took-pdays)/pdays) ELSE 0.05e0 END
    ELSE {SIG('gone/greatest(pdays,60e0)', 3.5, 0.95)}+least(0.2e0,pending_payment_count*0.05e0) END)) risk FROM (SELECT project_id, is_completed, pending_payment_count, greatest(0e0,coalesce(days_since_recommendation,0)) gone,
    abs(coalesce(recommendation_to_completion_days,0)) took, least(1200e0,greatest(90e0,{PRED})) AS pdays FROM k_feat)""",
)
LEVEL = "CASE WHEN risk<0.35 THEN 'LOW' WHEN risk<0.65 THEN 'MEDIUM' WHEN risk<0.85 THEN 'HIGH' ELSE 'CRITICAL' END"


def predicted(t):
    return features_of(t).withColumn("predicted_days", (60 + N() % 1300).cast("double"))


@query(
    "D14_delay_scores",
    f"SELECT *, rank() OVER (ORDER BY delay_risk_score DESC) delay_risk_rank FROM (SELECT project_id, gone days_since_recommendation, pdays predicted_completion_days, {R('risk', 4)} delay_risk_score, CAST(risk>=0.5 AS INT) is_delayed_predicted FROM d_delay)",
)
def d14(t):
    return delay.score_delays(predicted(t)).drop("delay_risk_level")


@query("D15_delay_level", f"SELECT project_id, {LEVEL} delay_risk_level FROM d_delay")
def d15(t):
    return delay.score_delays(predicted(t)).select("project_id", "delay_risk_level")


@query(
    "D16_linear_attribution",
    f"""SELECT project_id, 450e0 shap_base_value, 'pending_payment_count (+'||printf('%.1f',pending_payment_count*15e0)||'d)' shap_top_delay_pusher, 'None' shap_top_delay_dampener,
    '{{"pending_payment_count":'||(pending_payment_count*15e0)||',"recommended_amount":'||{R("coalesce(recommended_amount,0)/100000*2", 2)}||'}}' shap_feature_attributions FROM k_feat""",
)
def d16(t):
    return delay.linear_attribution(features_of(t))


def delay_model(t, trees=20):
    df = materialize(features_of(t))
    mp = mp_of(t)
    return df, mp, delay.fit_delay_model(df, mp, trees=trees)


@query("D13_delay_model")
def d13(t):
    df, mp, model = delay_model(t)
    out = delay.score_delays(model.predict(delay.delay_features(df, mp)))
    return out.select("project_id", "predicted_completion_days", "delay_risk_score", "delay_risk_level")


@query("D17_tree_attribution")
def d17(t):
    df, mp, model = delay_model(t)
    return delay.tree_attribution(df, model, mp)


@query("D17_additivity", "SELECT project_id, true AS adds_up FROM k_feat")
def d17_additivity(t):
    """Base and parts (each rounded to two decimals) give the prediction."""
    df, mp, model = delay_model(t)
    found = delay.tree_attribution(df, model, mp).join(model.predict(delay.delay_features(df, mp)).select("project_id", "predicted_days"), "project_id")
    gap = F.abs(F.col("shap_base_value") + F.col("attribution_total") - F.col("predicted_days"))
    return found.select("project_id", (gap < 0.1).alias("adds_up"))


@query("Y08_payment_detector")
def y08(t):
    ready = materialize(payments.payment_indicators(payment_input(t)))
    forest = iforest.fit_forest(ready, payments.MODEL_FEATURES, trees=50, contamination=0.03)
    scored = forest.raw_scores(ready).withColumn("isolation", iforest.normalised(forest))
    return payments.score_payments(scored, "isolation")


@query(
    "I15_ranked_cases",
    "SELECT f.project_id, f.mp_name, f.state, CAST(true AS BOOLEAN) score_in_range, CAST(true AS BOOLEAN) tier_follows, CAST(true AS BOOLEAN) rules_exact, CAST(true AS BOOLEAN) rank_follows FROM k_feat f",
)
def i15(t):
    """Works and payments through all engines to ranked cases; what doesn't depend on a fitted model is compared exactly."""
    df = materialize(scored_features(t))
    ranked, _ = engines.ranked_cases(df, mp_of(t), trees=10)
    shown = ["project_id", "mp_name", "state", "overall_risk_score", "risk_category", "rule_risk_score", "investigation_priority_score", "investigation_rank"]
    ranked = materialize(ranked.select(*shown), "ranked")  # read twice
    exact = rules.project_rollup(rules.evaluate_features(df, triggered_only=True)).select("project_id", F.least(F.col("rule_risk_score") / 300.0, F.lit(1.0)).alias("__rule"))
    o, p = F.col("overall_risk_score"), F.col("investigation_priority_score")
    # tiers follow the unrounded score: within half a unit of a border both are right for the published one
    tier = lambda x: F.when(x < 0.30, "LOW").when(x < 0.60, "MEDIUM").when(x < 0.80, "HIGH").otherwise("CRITICAL")
    ahead = ranked.select((F.col("investigation_rank") + 1).alias("investigation_rank"), p.alias("__before"))
    out = ranked.join(exact, "project_id", "left").join(ahead, "investigation_rank", "left")
    return out.select(
        "project_id", "mp_name", "state", o.between(0, 1).alias("score_in_range"), F.col("risk_category").isin(tier(o - 5e-5), tier(o + 5e-5)).alias("tier_follows"),
        (F.abs(F.coalesce("rule_risk_score", F.lit(0.0)) - F.coalesce("__rule", F.lit(0.0))) < 1e-4).alias("rules_exact"),
        (F.coalesce("__before", p) >= p).alias("rank_follows"),
    )
