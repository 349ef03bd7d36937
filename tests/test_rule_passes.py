"""The rules are the dearest expressions of the library: a plan works them out once a row."""

from pyspark.sql import functions as F

from ledgerlens.operators import ranking, rules


def project_rows(spark):
    n = F.col("id")
    return spark.range(40).select(
        F.concat(F.lit("p"), (n % 30).cast("string")).alias("project_id"), F.when(n % 5 != 0, "roads").alias("category"), F.lit("north").alias("constituency"),
        F.lit("state").alias("state"), (n % 2).cast("int").alias("is_completed"), (n / 10.0).alias("expenditure_ratio"), (n * 10).alias("days_since_recommendation"),
        F.when(n % 3 != 0, n - 5).alias("recommendation_to_completion_days"), (n * 100.0).alias("total_expenditure"),
        F.when(n % 7 != 0, F.lit(1000.0)).alias("recommended_amount"), F.lit(50.0).alias("average_payment"), (n % 4).alias("payment_count"), F.lit(80.0).alias("maximum_payment"),
    )


def filters(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.lstrip(" :+-").startswith("Filter")]


def test_no_filter_is_pushed_below_the_rules(spark):
    evaluated = rules.evaluate_features(project_rows(spark), triggered_only=True)
    rollup = rules.project_rollup(evaluated)
    assert not filters(rules.flagged_projects(rollup))
    assert not filters(rules.rule_events(evaluated))
    shared = rules.evaluate_features(project_rows(spark))
    assert shared.columns == [*project_rows(spark).columns, "findings"]


def test_flagged_rows_and_events_are_those_of_a_filter(spark):
    evaluated = rules.evaluate_features(project_rows(spark).withColumn("project_id", F.when(F.col("project_id") != "p3", F.col("project_id"))), triggered_only=True)
    rollup = rules.project_rollup(evaluated).cache()
    wanted = sorted(map(str, rollup.where("rule_count > 0").select("project_id", *rules.ROLLUP).collect()))
    assert sorted(map(str, rules.flagged_projects(rollup).collect())) == wanted
    every = rules.evaluate_features(project_rows(spark))
    assert rules.rule_events(every, all_results=True).count() == 40 * 15
    assert rules.rule_events(every).count() == rules.rule_events(evaluated).count()


def test_a_sort_reads_written_rows(spark, monkeypatch):
    written = []
    keep = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, name="table": written.append(name) or keep(df, name))
    ranked = ranking.sequence_rank(spark.range(100).select((F.col("id") % 10).alias("s"), "id"), [F.desc("s"), F.asc("id")], "place")
    assert written == ["unsorted", "sorted"]
    assert [r["id"] for r in ranked.orderBy("place").limit(3).collect()] == [9, 19, 29]
