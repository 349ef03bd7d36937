"""Planted facts for the scoring engines."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import agency, cost, delay, fusion, iforest, payments, quantiles, ranking, rules, warning

PAYMENT_COLUMNS = (
    "project_id string, recommended_amount double, total_expenditure double, expenditure_ratio double, payment_count double, average_payment double,"
    " maximum_payment double, payment_frequency double, pending_payment_count double, peer_median_cost double"
)


def normal_payments(n=100, seed=42):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        budget = r.uniform(200_000, 800_000)
        spent, count = budget * r.uniform(0.4, 0.95), r.randint(1, 3)
        rows.append((f"N{i}", budget, spent, spent / budget, float(count), spent / count, spent / count * 1.1, r.uniform(0.01, 0.08), 0.0, 500_000.0))
    return rows


PLANTED = [
    ("ROUND", 5e6, 3e6, 0.6, 3.0, 1e6, 1e6, 0.05, 0.0, 5e6),
    ("BURST", 5e5, 4e5, 0.8, 12.0, 33_333.3, 50_001.7, 2.0, 0.0, 5e5),
    ("CHURN", 5e6, 4e6, 0.8, 75.0, 53_333.3, 90_001.7, 0.3, 0.0, 5e6),
    ("OVERRUN", 1e5, 1.5e7, 150.0, 2.0, 7.5e6, 8e6, 0.05, 0.0, 1e5),
    ("LARGE", 5e7, 3.5e7, 0.7, 1.0, 3.5e7, 3.5e7, 0.01, 0.0, 4e7),
    ("PENDING", 5e5, 3e5, 0.6, 5.0, 60_001.3, 70_001.7, 0.05, 5.0, 5e5),
]


def scored_payments(spark, rows):
    ready = payments.payment_indicators(spark.createDataFrame(rows, PAYMENT_COLUMNS))
    forest = iforest.fit_forest(ready, payments.MODEL_FEATURES, trees=50, contamination=0.03)
    scored = forest.raw_scores(ready).withColumn("isolation", iforest.normalised(forest))
    return {r["project_id"]: r for r in payments.score_payments(scored, "isolation").collect()}


def test_payment_planted_cases(spark):
    out = scored_payments(spark, normal_payments() + PLANTED)
    normal = [r["payment_anomaly_score"] for k, r in out.items() if k.startswith("N")]
    assert sum(out[k]["is_payment_anomaly"] for k in out if k.startswith("N")) <= 10
    assert sorted(normal)[50] < 0.30
    assert "ROUND_FIGURE_DISBURSEMENT" in out["ROUND"]["payment_anomaly_type"] and out["ROUND"]["round_payment_indicator"] >= 0.70
    assert "RAPID_PAYMENT_BURST" in out["BURST"]["payment_anomaly_type"] and out["BURST"]["payment_frequency_indicator"] >= 0.70
    assert "TRANSACTION_CHURN_STRUCTURING" in out["CHURN"]["payment_anomaly_type"] and out["CHURN"]["is_payment_anomaly"] == 1
    assert out["OVERRUN"]["payment_anomaly_score"] >= 0.90 and "SEVERE_BUDGET_OVERRUN" in out["OVERRUN"]["payment_anomaly_type"]
    assert "LARGE_SINGLE_PAYMENT" in out["LARGE"]["payment_anomaly_type"]
    assert "PENDING_DISPUTE_RISK" in out["PENDING"]["payment_anomaly_type"]


def test_payment_missing_columns(spark):
    df = spark.createDataFrame([("A", 1000.0), ("B", 0.0)], "project_id string, total_expenditure double")
    ready = payments.payment_indicators(df)
    assert ready.filter("magnitude_risk_score is null or round_payment_indicator is null").count() == 0


@pytest.mark.parametrize("amount,weight", [(2e6, 1.0), (1.5e6, 0.85), (4e5, 0.75), (3e5, 0.65), (1.5e5, 0.5), (1.25e5, 0.35), (2e4, 0.25), (5e3, 0.15), (4e3, 0.0), (100_000.4, 0.0), (123_457.0, 0.0)])
def test_roundness(spark, amount, weight):
    assert spark.range(1).select(payments.amount_roundness(F.lit(amount)).alias("w")).first()["w"] == weight


def feature_rows(n, seed=7):
    r = random.Random(seed)
    return [
        (f"N{i}", a, a * u, u, (a - 500_000) / 5_000, 500_000.0, 510_000.0, 100_000.0, 0.4, float(r.randint(1, 4)), 0.0, float(r.randint(30, 300)))
        for i in range(n)
        for a, u in [(r.uniform(400_000, 600_000), r.uniform(0.3, 0.95))]
    ]


FEATURES = (
    "project_id string, recommended_amount double, total_expenditure double, expenditure_ratio double, cost_deviation_from_peer double, peer_median_cost double,"
    " peer_mean_cost double, peer_std_cost double, description_similarity_score double, payment_count double, pending_payment_count double, days_since_recommendation double"
)
ODD = [
    ("OVERRUN", 1e5, 3e5, 3.0, -80.0, 5e5, 5.1e5, 1e5, 0.4, 3.0, 0.0, 100.0),
    ("INFLATED", 5e6, 1e6, 0.2, 900.0, 5e5, 5.1e5, 1e5, 0.4, 3.0, 0.0, 100.0),
    ("BOILER", 2.2e6, 1e6, 0.45, 340.0, 5e5, 5.1e5, 1e5, 0.95, 3.0, 0.0, 100.0),
    ("CHEAP", 1e4, 5e3, 0.5, -98.0, 5e5, 5.1e5, 1e5, 0.4, 3.0, 0.0, 100.0),
]


def test_cost_planted_cases(spark):
    df = spark.createDataFrame(feature_rows(200) + ODD, FEATURES)
    out = {r["project_id"]: r for r in cost.detect_cost_anomalies(df).collect()}
    assert "SEVERE_EXPENDITURE_OVERRUN" in out["OVERRUN"]["cost_anomaly_type"] and out["OVERRUN"]["cost_anomaly_score"] >= 0.88
    assert "EXTREME_PEER_INFLATION" in out["INFLATED"]["cost_anomaly_type"] and out["INFLATED"]["is_cost_anomaly"] == 1
    assert "BOILERPLATE_COST_INFLATION" in out["BOILER"]["cost_anomaly_type"]
    assert "IMPLAUSIBLE_UNDERCOST" in out["CHEAP"]["cost_anomaly_type"]
    assert all(0 <= r["cost_anomaly_score"] <= 1 for r in out.values()) and len(out) == 204


def test_isolation_ranks_planted_first(spark):
    odd = [(f"ODD{i}", 5e7 * (i + 1), 9e7, 40.0, 5000.0, 5e5, 5e5, 1e5, 0.99, 90.0, 20.0, 3000.0) for i in range(4)]
    df = spark.createDataFrame(feature_rows(300) + odd, FEATURES)
    a = {r["project_id"]: r for r in iforest.score_forest(df, iforest.fit_forest(df)).collect()}
    assert len(a) == 304
    assert all(a[f"ODD{i}"]["anomaly_rank"] <= 8 and a[f"ODD{i}"]["is_anomaly"] == 1 for i in range(4))
    assert all(0 <= r["anomaly_score"] <= 1 for r in a.values())
    b = {r["project_id"]: r["anomaly_score"] for r in iforest.score_forest(df.repartition(7), iforest.fit_forest(df.repartition(7))).collect()}
    assert b == {k: r["anomaly_score"] for k, r in a.items()}


def test_delay_model(spark):
    r = random.Random(1)
    columns = "project_id string, is_completed int, recommendation_to_completion_days double, days_since_recommendation double, recommended_amount double, category string, payment_count double, pending_payment_count double, has_images boolean, mp_name string"
    rows = [(f"C{i}", 1, -float(r.randint(200, 500)), 600.0, r.uniform(1e5, 9e5), "Normal/Others", 2.0, 0.0, True, "M1") for i in range(80)]
    rows += [("FRESH", 0, None, 10.0, 5e5, "Normal/Others", 1.0, 0.0, False, "M1"), ("OVERDUE", 0, None, 2500.0, 5e5, "Normal/Others", 1.0, 3.0, False, "M2")]
    df = spark.createDataFrame(rows, columns)
    model = delay.fit_delay_model(df, trees=10)
    out = {x["project_id"]: x for x in delay.score_delays(model.predict(delay.delay_features(df))).collect()}
    assert out["FRESH"]["delay_risk_score"] < 0.35 and out["OVERDUE"]["delay_risk_level"] == "CRITICAL"
    assert all(90 <= x["predicted_completion_days"] <= 1200 for x in out.values())
    shap = delay.tree_attribution(df, model).join(model.predict(delay.delay_features(df)), "project_id")
    worst = shap.select(F.max(F.abs(F.col("shap_base_value") + F.col("attribution_total") - F.col("predicted_days"))).alias("d")).first()["d"]
    assert worst < 0.1  # contributions add up to the prediction, but for rounding


def test_agency_contrast(spark):
    columns = "project_id string, agency_name string, agency_id string, is_completed int, is_delayed int, delay_days double, recommended_amount double, total_expenditure double, is_anomaly int, pending_payment_count int"
    rows = [(f"G{i}", "Good", "A1", 1, 0, 0.0, 1e5, 9e4, 0, 0) for i in range(20)]
    rows += [(f"P{i}", "Poor", "A2", int(i % 5 == 0), 1, 200.0, 1e5, 1.6e5, 1, 2) for i in range(20)]
    rows += [("S0", "Single", "A3", 0, 1, 200.0, 1e5, 1.6e5, 1, 2)]
    out = {r["agency_name"]: r for r in agency.profile_projects(spark.createDataFrame(rows, columns), "agency_name").collect()}
    assert out["Poor"]["agency_risk_score"] > 60 > out["Good"]["agency_risk_score"]
    assert 15 < out["Single"]["agency_risk_score"] < out["Poor"]["agency_risk_score"]
    assert "Low historical volume" in out["Single"]["risk_reasons"] and out["Poor"]["agency_id"] == "A2"


def test_rule_aggregate(spark):
    rows = [
        ("P100", "R1", "a", 1, "LOW", "x"), ("P100", "R2", "b", 1, "CRITICAL", "y"), ("P100", "R3", "c", 1, "HIGH", "z"), ("P200", "R1", "a", 0, "HIGH", "n"),
    ]
    df = spark.createDataFrame(rows, "project_id string, rule_id string, rule_name string, triggered int, severity string, reason string")
    (row,) = rules.aggregate_rule_events(df).collect()
    assert (row["project_id"], row["rule_event_count"], row["max_rule_severity"], row["max_rule_severity_score"]) == ("P100", 3, "CRITICAL", 75.0)
    assert row["rule_ids_triggered"] == "R2; R3; R1"


def test_registered_rule_joins_the_suite(spark):
    @rules.register_rule
    def always(p):
        return rules.rule_result("USER-1", "always", "USER", F.lit(True), "LOW", "hello")

    try:
        df = spark.createDataFrame([("P", "completed")], "project_id string, status string")
        ids = [f["rule_id"] for f in rules.evaluate_records(df, "2024-01-01").first()["findings"]]
        assert ids[-1] == "USER-1" and len(ids) == 16
    finally:
        rules.EXTRA_RULES.clear()


def test_fusion_renormalises_and_tiers(spark):
    base = spark.createDataFrame([("A", "m"), ("B", "m")], "project_id string, mp_name string")
    costs = spark.createDataFrame([("A", 0.85, 1, "X"), ("B", 0.10, 0, "NORMAL")], "project_id string, cost_anomaly_score double, is_cost_anomaly int, cost_anomaly_type string")
    from ledgerlens.plans.risk import fused_features

    out = {r["project_id"]: r for r in fused_features(base, {"cost_anomaly": costs}).collect()}
    assert out["A"]["overall_risk_score"] == 0.85 and out["A"]["risk_category"] == "CRITICAL"
    assert out["B"]["risk_category"] == "LOW" and len(out) == 2
    with pytest.raises(ValueError):
        fusion.fuse(base, {"cost": 0.5})
    with pytest.raises(ValueError):
        fusion.safe_left_join(base, costs.union(costs), "cost", check=True)


def test_trends_alerts_priority(spark):
    df = spark.createDataFrame(
        [("A", 100, 500_000.0, 600_000.0, 0, "c", "s"), ("B", 400, 0.0, 500_000.0, 0, "c", "s")],
        "project_id string, days_since_recommendation int, total_expenditure double, recommended_amount double, is_completed int, category string, state string",
    )
    out = {r["project_id"]: r for r in warning.analyze_trends(df).collect()}
    assert out["A"]["spend_velocity_daily"] == 5000.0 and out["B"]["burn_rate_status"] == "STALLED_DECAY"
    one = df.filter("project_id = 'A'").withColumns({"expenditure_ratio": F.lit(1.5), "payment_risk_flag": F.lit(True), "mp_name": F.lit("M")})
    assert {r["alert_code"] for r in warning.generate_alerts(one).collect()} == {"WARN_BUDGET_OVERRUN", "WARN_PAYMENT_CHURN"}
    cases = spark.createDataFrame([("H", 0.9, 2e6), ("L", 0.05, 1e3), ("M", 0.5, 1e5)], "project_id string, overall_risk_score double, total_expenditure double")
    ranked = {r["project_id"]: r for r in warning.rank_cases(cases).collect()}
    assert ranked["H"]["investigation_urgency"].startswith("TIER_1") and ranked["L"]["investigation_urgency"] == "TIER_4_ROUTINE"
    assert sorted(r["investigation_rank"] for r in ranked.values()) == [1, 2, 3] and ranked["H"]["investigation_rank"] == 1


def test_ranks_of_scores_that_differ_little(spark):
    scores = [0.5, 0.5 + 1e-9, 0.5 - 1e-9, 0.5, None, 3e5, -1.0, 0.5 + 1e-9] + [0.25] * 500
    df = spark.createDataFrame([(i, x) for i, x in enumerate(scores)], "i int, s double").repartition(6)
    got = {r["i"]: r["r"] for r in ranking.competition_rank(df, "s", "r").collect()}
    assert got == {i: None if x is None else 1 + sum(y is not None and y > x for y in scores) for i, x in enumerate(scores)}


def test_quantiles_of_one_huge_group(spark, monkeypatch):
    """Rounds of counts until a bracket holds few values: ties, far outliers, nearly equal values, and small groups beside."""
    import numpy as np

    rng = np.random.default_rng(4)
    huge = np.concatenate([rng.normal(size=6000), np.full(3000, 0.25), 1 + np.arange(3000) * 1e-12, [-1e300, 1e300]])
    rows = [("h", float(v)) for v in huge] + [(None, float(v)) for v in rng.normal(size=90)] + [("one", 5.0), ("h", None)]
    monkeypatch.setattr(quantiles, "BAND", 8)
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    monkeypatch.setattr(quantiles, "BUCKETS", 16)
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.62, "e": 0.75, "f": 0.9, "g1": 1.0}
    values = {}
    for g, v in rows:
        if v is not None:
            values.setdefault(g, []).append(v)
    for row in quantiles.group_quantiles(df, ["g"], "v", probs).collect():
        for name, p in probs.items():
            assert row[name] == pytest.approx(float(np.quantile(values[row["g"]], p)), rel=1e-12), (row["g"], name)


def test_quantiles_against_sorting(spark):
    import numpy as np

    r = np.random.default_rng(3)
    groups = {"big": r.lognormal(3, 2, 30_000).round(2), "ties": r.integers(0, 4, 2_001).astype(float), "one": np.array([5.0]), "two": np.array([1.0, 4.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    probs = {"p05": 0.05, "q1": 0.25, "med": 0.5, "p95": 0.95}
    for row in quantiles.group_quantiles(df, ["g"], "v", probs).collect():
        for name, p in probs.items():
            assert row[name] == pytest.approx(float(np.quantile(groups[row["g"]], p)), rel=1e-12), (row["g"], name)


def test_keep_first_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert {r["k"]: r["v"] for r in ranking.keep_last(df, ["k"], ["o"]).collect()} == {"a": "y", "b": "z"}
    assert {r["k"]: r["v"] for r in ranking.keep_first(df, ["k"], ["o"]).collect()} == {"a": "x", "b": "z"}


def test_project_rows_of_agencies_are_computed_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(df):
        def run(parts):
            for x in parts:
                read.add(x.num_rows)
                yield x

        return df.mapInArrow(run, df.schema)

    rows = [(f"p{i}", f"a{i % 3}" if i % 10 else None, float(i), 50.0, i % 2) for i in range(60)]
    projects = spark.createDataFrame(rows, "project_id string, agency string, total_expenditure double, recommended_amount double, is_completed int")
    got = {r["agency_name"]: r for r in agency.project_performance(counted(projects), "agency").collect()}
    assert read.value == 60
    for name in ("a0", "a1", "a2"):
        own = sorted(r[2] for r in rows if r[1] == name)
        assert got[name]["total_projects"] == len(own) and got[name]["median_project_cost"] == (own[len(own) // 2] + own[(len(own) - 1) // 2]) / 2
        assert got[name]["completed_projects"] == sum(r[4] for r in rows if r[1] == name)
