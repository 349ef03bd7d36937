"""Joining the engines' results into one risk table, and fusing their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import clip, clip_or_null, fixed, ladder, rounded
from ledgerlens.operators.quality import key_report
from ledgerlens.operators.ranking import keep_first


def join_mp_summary(df: DataFrame, mp_summary: DataFrame) -> DataFrame:
    """Left join on the MP's name after reducing the summary to one row per MP; the left side's columns win."""
    fresh = [c for c in mp_summary.columns if c not in df.columns]
    single = keep_first(mp_summary, ["mp_name"], []).select("mp_name", *fresh)
    return df.join(single, "mp_name", "left")


def lookup_join(df: DataFrame, lookup: DataFrame, key: str, default: object = None) -> DataFrame:
    """Left join with a one-row-per-key lookup; ``default`` replaces missing values."""
    values = [c for c in lookup.columns if c != key]
    joined = df.join(lookup, key, "left")
    if default is None:
        return joined
    return joined.withColumns({c: F.coalesce(c, F.lit(default)) for c in values})


# --- safe joins -----------------------------------------------------------------------------------

# Columns taken from each engine's result, and their new names.
ENGINE_COLUMNS = {
    "cost_anomaly": [
        "cost_anomaly_score", "is_cost_anomaly", "cost_anomaly_type", "cost_z_score", "cost_deviation_from_peer",
        "peer_median_cost",
    ],
    "delay_predictions": ["delay_risk_score", "delay_risk_level", "is_delayed_predicted", "predicted_completion_days"],
    "isolation_forest": ["anomaly_score", "anomaly_label", "is_anomaly", "top_anomaly_drivers"],
    "payment_anomaly": [
        "payment_anomaly_score", "is_payment_anomaly", "payment_anomaly_type", "round_payment_indicator",
        "payment_frequency_indicator", "budget_payment_ratio", "peer_payment_deviation",
    ],
    "rule_flagged": ["rule_risk_score", "risk_band", "rules_triggered", "rule_count", "top_reasons"],
    "rule_aggregated_events": [
        "rule_event_count", "max_rule_severity", "max_rule_severity_score", "rule_ids_triggered", "rule_reasons_summary",
    ],
    "similarity_projects": [
        "max_similarity_score", "duplicate_count", "exact_text_duplicate_flag", "high_text_similarity_flag",
        "generic_template_pair_flag", "cross_mp_duplicate_flag", "same_constituency_duplicate_flag", "duplicate_risk_score",
    ],
    "similarity_pair_aggregates": [
        "pair_duplicate_count", "max_pair_similarity_score", "max_pair_risk_score", "pair_exact_text_flag",
        "pair_critical_geo_flag",
    ],
}
ENGINE_RENAMES = {
    "isolation_forest": {"anomaly_score": "iforest_score", "is_anomaly": "iforest_is_anomaly"},
    "rule_flagged": {
        "rule_risk_score": "raw_rule_risk_score", "risk_band": "rule_risk_band", "top_reasons": "rule_top_reasons",
    },
}


def safe_left_join(
    base: DataFrame,
    incoming: DataFrame | None,
    name: str,
    columns: list[str] | None = None,
    renames: dict[str, str] | None = None,
    key: str = "project_id",
    check: bool = False,
) -> DataFrame:
    """Left join that cannot clash: the base's columns win, ``has_<name>`` marks the matched rows.

    ``check`` runs one aggregate first and raises on null or repeated keys.
    """
    marker = f"has_{name}"
    if incoming is None:
        return base.withColumn(marker, F.lit(False))
    if check:
        report = key_report(incoming, name, key).first()
        if not report["is_valid"]:
            raise ValueError(f"{name}: {report['null_count']} null keys, {report['duplicate_count']} repeated rows in {key}")
    kept = [c for c in (columns or incoming.columns) if c in incoming.columns and c != key]
    side = incoming.select(key, *kept).withColumnsRenamed(renames or {})
    fresh = [c for c in side.columns if c != key and c not in base.columns]
    joined = base.join(side.select(key, *fresh, F.lit(True).alias(marker)), key, "left")
    return joined.withColumn(marker, F.coalesce(marker, F.lit(False)))


def merge_all(base: DataFrame, engines: dict[str, DataFrame | None], check: bool = False) -> DataFrame:
    """All engine results on the projects.  Every join uses the project id, so the base is shuffled once."""
    merged = base
    for name, columns in ENGINE_COLUMNS.items():
        merged = safe_left_join(merged, engines.get(name), name, columns, ENGINE_RENAMES.get(name), check=check)
    return merged


def match_report(merged: DataFrame) -> DataFrame:
    """Matched and unmatched rows and coverage per joined feature, in one pass."""
    markers = [c for c in merged.columns if c.startswith("has_") and c != "has_images"]
    counts = merged.agg(F.count("*").alias("__n"), *[F.count_if(F.col(m)).alias(m) for m in markers])
    rows = F.array(*[F.struct(F.lit(m[4:]).alias("feature"), F.col(m).alias("matched_rows")) for m in markers])
    return counts.select("__n", F.inline(rows)).select(
        "feature",
        "matched_rows",
        (F.col("__n") - F.col("matched_rows")).alias("unmatched_rows"),
        rounded(F.col("matched_rows") / F.col("__n") * 100, 2).alias("coverage_pct"),
    )


# --- pairs to projects ----------------------------------------------------------------------------


def both_sides(pairs: DataFrame) -> DataFrame:
    """Each pair once per member, as ``project_id``."""
    return pairs.withColumn("project_id", F.explode(F.array("project_id_a", "project_id_b")))


def aggregate_pairs(pairs: DataFrame) -> DataFrame:
    """Pair count, best similarity and risk, and flags per project."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in pairs.columns else F.lit(0.0)
    label = F.coalesce("geo_risk_label", F.lit("")) if "geo_risk_label" in pairs.columns else F.lit("")
    return (
        both_sides(pairs)
        .filter(F.col("project_id").isNotNull())
        .groupBy("project_id")
        .agg(
            F.count("*").alias("pair_duplicate_count"),
            F.max(number("similarity_score")).alias("max_pair_similarity_score"),
            F.max(number("pair_risk_score")).alias("max_pair_risk_score"),
            F.max(number("exact_text_duplicate_flag").cast("int")).alias("pair_exact_text_flag"),
            F.max(F.contains(label, F.lit("CRITICAL_GEO")).cast("int")).alias("pair_critical_geo_flag"),
        )
    )


# Points of the 0..100 duplicate score and how much a shared place counts.
DUPLICATE_WEIGHTS = {"similarity": 50.0, "duplicate_count": 15.0, "cross_mp": 15.0, "location": 10.0, "budget_inflation": 10.0}
PLACE_WEIGHTS = {"SAME_CONSTITUENCY": 1.0, "SAME_STATE_DIFF_CONST": 0.7, "DIFF_STATE": 0.4}
INFLATED = ["HIGH_BUDGET_INFLATION", "CRITICAL_BUDGET_INFLATION"]


def project_similarity_features(
    pairs: DataFrame, projects: DataFrame, weights: dict[str, float] | None = None, locations: DataFrame | None = None
) -> DataFrame:
    """One row per project from annotated pairs; projects without pairs keep zeros.

    Direction does not matter and a repeated pair counts once.
    """
    points = DUPLICATE_WEIGHTS | (weights or {})
    column = lambda c, default: F.col(c) if c in pairs.columns else F.lit(default)
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("long"))
    unordered = pairs.select(
        F.least("project_id_a", "project_id_b").alias("project_id_a"),
        F.greatest("project_id_a", "project_id_b").alias("project_id_b"),
        F.greatest(F.coalesce(F.col("similarity_score").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("similarity"),
        F.greatest(F.coalesce(column("cost_ratio", 0.0).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("cost_ratio"),
        (column("is_generic_a", False).cast("boolean") | column("is_generic_b", False).cast("boolean")).alias("generic"),
        (~column("mp_a", "").eqNullSafe(column("mp_b", ""))).alias("cross_mp"),
        column("geo_relationship", "").alias("place"),
        F.upper(column("budget_anomaly_label", "")).isin(INFLATED).alias("inflated"),
    ).filter("project_id_a <> project_id_b")
    single = keep_first(unordered, ["project_id_a", "project_id_b"], [])
    place = F.element_at(F.create_map(*[F.lit(x) for kv in PLACE_WEIGHTS.items() for x in kv]), F.col("place"))
    sides = both_sides(single).groupBy("project_id").agg(
        F.max("similarity").alias("max_similarity_score"),
        F.count("*").alias("duplicate_count"),
        flag(F.col("similarity") >= 0.97).alias("exact_text_duplicate_flag"),
        flag(F.col("similarity") >= 0.85).alias("high_text_similarity_flag"),
        flag(F.col("generic")).alias("generic_template_pair_flag"),
        flag(F.col("cross_mp")).alias("cross_mp_duplicate_flag"),
        flag(F.col("place") == "SAME_CONSTITUENCY").alias("same_constituency_duplicate_flag"),
        flag(F.col("place") == "SAME_STATE_DIFF_CONST").alias("same_state_duplicate_flag"),
        flag(F.col("place") == "DIFF_STATE").alias("different_state_duplicate_flag"),
        F.max("cost_ratio").alias("max_cost_ratio"),
        flag(F.col("inflated")).alias("budget_inflation_flag"),
        F.max(F.coalesce(place, F.lit(0.0))).alias("__place"),
    )
    ids = projects.select("project_id").unionByName(sides.select("project_id")).distinct()
    values = [c for c in sides.columns if c != "project_id"]
    out = ids.join(sides, "project_id", "left").fillna(0, values)
    located = F.lit(False)
    if locations is not None:
        out = out.join(locations.select("project_id", F.lit(True).alias("__located")).distinct(), "project_id", "left")
        located = F.coalesce("__located", F.lit(False))
    score = (
        F.col("max_similarity_score") * points["similarity"]
        + F.least(F.col("duplicate_count"), F.lit(10)) / 10.0 * points["duplicate_count"]
        + F.col("cross_mp_duplicate_flag") * points["cross_mp"]
        + F.col("__place") * points["location"]
        + F.col("budget_inflation_flag") * points["budget_inflation"]
    )
    return out.select(
        "project_id", *[v for v in values if v != "__place"], located.cast("long").alias("location_data_available"),
        F.when(located, "verified_gps_metadata_only").otherwise("administrative_area").alias("location_source"),
        rounded(F.least(score, F.lit(100.0)), 4).alias("duplicate_risk_score"),
    )


# --- signals --------------------------------------------------------------------------------------

ENGINES = ["cost", "delay", "payment", "rule", "similarity", "iforest"]
# Engine weights and tiers.
WEIGHTS = {"cost": 0.20, "delay": 0.20, "payment": 0.20, "rule": 0.20, "similarity": 0.10, "iforest": 0.10}
TIERS = [(0.80, "CRITICAL"), (0.60, "HIGH"), (0.30, "MEDIUM")]


def _signal(df: DataFrame, engine: str, score: str, scale: float, flags: list[Column], cut: float) -> dict[str, Column]:
    value = F.col(score).try_cast("double")
    value = F.when(~F.isnan(value), value)
    level = clip_or_null(value / scale if scale != 1 else value, 0, 1)
    raised = F.coalesce(level >= cut, F.lit(False))
    for f in flags:
        raised = raised | F.coalesce(f, F.lit(False))
    return {f"{engine}_available": value.isNotNull(), f"{engine}_risk_score": level, f"{engine}_risk_flag": raised & value.isNotNull()}


def _unavailable(engine: str) -> dict[str, Column]:
    return {
        f"{engine}_available": F.lit(False),
        f"{engine}_risk_score": F.lit(None).cast("double"),
        f"{engine}_risk_flag": F.lit(False),
    }


def signal_columns(df: DataFrame, engine: str, similarity_scale: float = 1.0) -> dict[str, Column]:
    """Availability, score in [0, 1] and flag of one engine, from the columns that are there."""
    one = lambda c: F.col(c).cast("int") == 1 if c in df.columns else F.lit(False)
    has = lambda c: c in df.columns
    if engine == "cost" and has("cost_anomaly_score"):
        return _signal(df, "cost", "cost_anomaly_score", 1, [one("is_cost_anomaly")], 0.60)
    if engine == "delay" and has("delay_risk_score"):
        late = F.upper("delay_risk_level").isin("HIGH", "CRITICAL") if has("delay_risk_level") else F.lit(False)
        return _signal(df, "delay", "delay_risk_score", 1, [one("is_delayed_predicted"), late], 2.0)
    if engine == "payment" and has("payment_anomaly_score"):
        return _signal(df, "payment", "payment_anomaly_score", 1, [one("is_payment_anomaly")], 0.50)
    if engine == "rule" and has("raw_rule_risk_score"):
        some = F.col("rule_count") > 0 if has("rule_count") else F.lit(False)
        return _signal(df, "rule", "raw_rule_risk_score", 300, [some], 2.0)
    if engine == "rule" and has("max_rule_severity_score"):
        return _signal(df, "rule", "max_rule_severity_score", 100, [F.col("max_rule_severity_score") > 0], 2.0)
    if engine == "similarity" and has("duplicate_risk_score"):
        flags = [one("exact_text_duplicate_flag"), one("high_text_similarity_flag")]
        return _signal(df, "similarity", "duplicate_risk_score", similarity_scale, flags, 0.50)
    if engine == "similarity" and has("max_pair_risk_score"):
        return _signal(df, "similarity", "max_pair_risk_score", 1, [], 0.50)
    if engine == "iforest" and has("iforest_score"):
        return _signal(df, "iforest", "iforest_score", 1, [one("iforest_is_anomaly")], 0.50)
    return _unavailable(engine)


def build_signals(df: DataFrame, similarity_scale: float = 1.0) -> DataFrame:
    """Signals of all six engines.

    The duplicate score runs to 100 but is clipped at 1 by default, as published; ``similarity_scale=100``
    maps it onto [0, 1] first.
    """
    out: dict[str, Column] = {}
    for engine in ENGINES:
        out |= signal_columns(df, engine, similarity_scale)
    return df.withColumns(out)


# --- fusion ---------------------------------------------------------------------------------------


def check_weights(weights: dict[str, float]) -> None:
    if abs(sum(weights.values()) - 1) > 1e-4 or any(not 0 <= w <= 1 for w in weights.values()):
        raise ValueError(f"risk weights must lie in [0, 1] and sum to 1: {weights}")


def _active(engine: str) -> Column:
    return F.col(f"{engine}_available") & F.col(f"{engine}_risk_score").isNotNull()


def active_weight(weights: dict[str, float] = WEIGHTS) -> Column:
    return sum((F.when(_active(e), F.lit(w)).otherwise(0.0) for e, w in weights.items()), F.lit(0.0))


def overall_score(total: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean over the engines that have a score; 0 when none has."""
    terms = [F.when(_active(e), F.lit(w) / total * F.col(f"{e}_risk_score")).otherwise(0.0) for e, w in weights.items()]
    return F.when(total > 0, clip(sum(terms, F.lit(0.0)), 0, 1)).otherwise(0.0)


def risk_category(score: Column) -> Column:
    return F.when(score.isNull() | F.isnan(score), "UNKNOWN").otherwise(ladder(score, TIERS, "LOW"))


def top_signals(total: Column, overall: Column, weights: dict[str, float] = WEIGHTS, n: int = 3) -> Column:
    """Texts of the ``n`` engines that contribute most; ties keep the engines' order."""
    rows = [
        F.when(
            _active(e) & (overall > 0),
            F.struct(
                (-(F.lit(w) / total * F.col(f"{e}_risk_score") / overall * 100)).alias("minus"),
                F.lit(i).alias("place"),
                F.lit(e.title()).alias("label"),
                F.col(f"{e}_risk_score").alias("score"),
            ),
        )
        for i, (e, w) in enumerate(weights.items())
    ]
    best = F.slice(F.array_sort(F.array_compact(F.array(*rows))), 1, n)
    return F.transform(
        best,
        lambda s: F.concat(
            s["label"], F.lit(" (Score: "), fixed(s["score"], 2), F.lit(", Weight: "), fixed(-s["minus"], 1), F.lit("%)")
        ),
    )


def _has(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def _raised(engine: str, cut: float) -> Column:
    return F.col(f"{engine}_risk_flag") | F.coalesce(F.col(f"{engine}_risk_score") >= cut, F.lit(False))


def _spaced(c: Column, default: str) -> Column:
    return F.translate(F.coalesce(c.cast("string"), F.lit(default)), "_", " ")


def _scored(engine: str) -> Column:
    return F.concat(F.lit(" (Score: "), fixed(F.coalesce(f"{engine}_risk_score", F.lit(0.0)), 2), F.lit(")"))


def _optional(c: Column, *parts: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(*parts)).otherwise("")


def risk_factors(df: DataFrame, brief: bool = False, shown: int | None = None) -> Column:
    """Sentences for the raised engines, or one nominal sentence; ``brief`` is the reason generator's wording.

    ``shown`` cuts the list of drivers to so many characters, for display.
    """
    z, days = _has(df, "cost_z_score").cast("double"), _has(df, "predicted_completion_days").cast("long")
    rules = F.coalesce(_has(df, "rules_triggered"), _has(df, "rule_ids_triggered"), F.lit("Rules Triggered"))
    rule_count = F.coalesce(_has(df, "rule_count"), _has(df, "rule_event_count"), F.lit(1)).cast("long").cast("string")
    pairs = F.coalesce(_has(df, "duplicate_count"), _has(df, "pair_duplicate_count"), F.lit(1)).cast("long").cast("string")
    similarity = F.coalesce("similarity_risk_score", F.lit(0.0))
    if not brief:
        similarity = F.coalesce(_has(df, "max_similarity_score").cast("double"), similarity)
    exact = F.coalesce(_has(df, "exact_text_duplicate_flag").cast("int") == 1, F.lit(False))
    drivers = F.trim(F.coalesce(_has(df, "top_anomaly_drivers").cast("string"), F.lit("")))
    words = (
        ("σ deviation)", "stall", "Payment Structuring", "Verbatim Duplicate Match", "Multivariate ML Outlier: High-dimensional deviation",
         "Nominal project execution: operational metrics within normal historical tolerances.")
        if brief
        else ("σ)", "delay", "Payment Anomaly", "Verbatim Text Match", "Multivariate ML Anomaly: High dimensional deviation",
              "Nominal project indicators: execution within normal baseline variance.")
    )
    found = F.array_compact(
        F.array(
            F.when(
                _raised("cost", 0.5),
                F.concat(F.lit("Cost Anomaly: "), _spaced(_has(df, "cost_anomaly_type"), "INFLATION"),
                         _optional(z, F.lit(" (+"), fixed(z, 1), F.lit(words[0])), _scored("cost")),
            ),
            F.when(
                _raised("delay", 0.5),
                F.concat(F.lit(f"Delay Risk: Forecasted project {words[1]}"),
                         _optional(days, F.lit(" (~"), days.cast("string"), F.lit(" days predicted)")), _scored("delay")),
            ),
            F.when(
                _raised("payment", 0.5),
                F.concat(F.lit(f"{words[2]}: "), _spaced(_has(df, "payment_anomaly_type"), "UNUSUAL_PAYMENT"), _scored("payment")),
            ),
            F.when(
                _raised("rule", 0.3),
                F.concat(F.lit("Rule Violations: "), rules, F.lit(" ["), rule_count, F.lit(" triggered]"), _scored("rule")),
            ),
            F.when(
                _raised("similarity", 0.5),
                F.concat(F.lit("Duplicate Work Alert: "), fixed(similarity, 2), F.lit(" text similarity with "), pairs,
                         F.lit(" project(s)"), F.when(exact, f" [{words[3]}]").otherwise("")),
            ),
            F.when(
                _raised("iforest", 0.5),
                F.concat(F.lit(words[4]),
                         F.when(drivers != "", F.concat(F.lit(" [Drivers: "), *([drivers, F.lit("]")] if shown is None else [F.left(drivers, F.lit(shown)), F.lit("...]")]))).otherwise("")),
            ),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(words[5])))


def audit_explanation(score: Column, category: Column, signals: Column) -> Column:
    shown = fixed(score, 2)
    return (
        F.when(
            score >= 0.60,
            F.concat(F.lit("Flagged as "), category, F.lit(" RISK (score "), shown, F.lit("). Primary drivers: "),
                     F.array_join(F.slice(signals, 1, 2), "; "), F.lit(".")),
        )
        .when(
            score >= 0.30,
            F.concat(F.lit("Classified as "), category, F.lit(" RISK (score "), shown,
                     F.lit("). Moderate operational or financial friction observed.")),
        )
        .otherwise(
            F.concat(F.lit("Classified as LOW RISK (score "), shown, F.lit("). Performance metrics within expected parameters."))
        )
    )


def evidence_payload(weights: dict[str, float] = WEIGHTS) -> Column:
    """JSON with scores, texts, component scores (nulls kept) and the renormalised weights of the active engines."""
    scores = F.struct(*[rounded(F.col(f"{e}_risk_score"), 4).alias(f"{e}_risk") for e in weights])
    pairs = F.map_from_entries(
        F.array_compact(
            F.array(
                *[
                    F.when(_active(e), F.struct(F.lit(f"{e}_risk"), rounded(F.lit(w) / F.col("__weight"), 4)))
                    for e, w in weights.items()
                ]
            )
        )
    )
    return F.to_json(
        F.struct(
            F.col("overall_risk_score"), F.col("risk_category"), F.col("audit_explanation"),
            F.col("__signals").alias("top_risk_signals"), F.col("__factors").alias("risk_factors"),
            scores.alias("component_scores"), pairs.alias("active_weights"),
        ),
        {"ignoreNullFields": "false"},
    )


def fuse(signals: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Overall score, tier, explanation, signals, factors and evidence per project."""
    check_weights(weights)
    df = signals.withColumn("__weight", active_weight(weights))
    df = df.withColumn("__overall", overall_score(F.col("__weight"), weights))
    overall = F.col("__overall")
    df = df.withColumns(
        {
            "__signals": top_signals(F.col("__weight"), overall, weights),
            "__factors": risk_factors(df),
            "risk_category": risk_category(overall),
        }
    )
    df = df.withColumns(
        {
            "overall_risk_score": rounded(overall, 4),
            "audit_explanation": audit_explanation(overall, F.col("risk_category"), F.col("__signals")),
            "top_risk_signals": F.array_join("__signals", "; "),
            "risk_factors": F.to_json("__factors"),
            "risk_factors_shown": F.to_json(risk_factors(df, shown=80)),
        }
    )
    df = df.withColumn("evidence_payload", evidence_payload(weights))
    return df.drop("__weight", "__overall", "__signals", "__factors")


PAYLOAD_SCHEMA = "component_scores map<string,double>, active_weights map<string,double>"


def contributions(df: DataFrame) -> DataFrame:
    """Points of each engine from the evidence payload, and whether they add up to the displayed score (within 0.5)."""
    parsed = F.from_json("evidence_payload", PAYLOAD_SCHEMA)
    points = F.map_filter(
        F.transform_values(
            F.col("__p.active_weights"), lambda k, w: rounded(F.element_at(F.col("__p.component_scores"), k) * w * 100, 2)
        ),
        lambda _, v: v.isNotNull(),
    )
    total = F.aggregate(F.map_values("points"), F.lit(0.0), lambda acc, v: acc + v)
    return (
        df.select("project_id", "overall_risk_score", parsed.alias("__p"))
        .withColumn("points", points)
        .withColumn("total", rounded(total, 2))
        .select(
            "project_id", "points", "total",
            (F.abs(F.col("total") - F.rint(F.col("overall_risk_score") * 100)) <= 0.5).alias("is_consistent"),
        )
    )


def executive_reasons(df: DataFrame) -> DataFrame:
    """Reason generator: summary sentence and the list of factors."""
    score = F.col("overall_risk_score")
    summary = (
        F.when(score >= 0.60, "CRITICAL RISK: Severe financial, delay, or compliance anomalies detected. Immediate audit recommended.")
        .when(score >= 0.30, "MODERATE RISK: Notable operational friction or cost deviations observed. Priority monitoring advised.")
        .otherwise("LOW RISK: Project performance aligns with standard baseline execution.")
    )
    return df.select(
        "project_id", "overall_risk_score", F.upper("risk_category").alias("risk_category"),
        summary.alias("executive_summary"), risk_factors(df, brief=True).alias("risk_factors"),
    )


# Engine names on the project page.
ENGINE_TITLES = {
    "cost": "Cost Anomaly",
    "delay": "Delay Prediction",
    "payment": "Payment Anomaly",
    "rule": "Compliance & Ghost Rules",
    "similarity": "Duplicate Work Similarity",
    "iforest": "Multivariate Isolation Forest",
}


def engine_breakdown(risk: DataFrame) -> DataFrame:
    """Six rows per project: engine, score, flag, availability."""
    rows = F.array(
        *[
            F.struct(
                F.lit(title).alias("engine"), F.col(f"{e}_risk_score").alias("score"), F.col(f"{e}_risk_flag").alias("flag"),
                F.col(f"{e}_available").alias("available"),
            )
            for e, title in ENGINE_TITLES.items()
        ]
    )
    return risk.select("project_id", F.inline(rows))
