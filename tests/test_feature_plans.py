"""How often the wide rows of the feature step are shuffled, on tables too large to be broadcast."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.catalog import load_all
from ledgerlens.operators import features
from ledgerlens.sources.testtables import Tables


@pytest.fixture
def small_broadcasts(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, str(size))
    spark.conf.set(name, before)


def below(plan: str, marker: str) -> list[str]:
    """The lines under each line of the plan that holds ``marker``, by their indentation."""
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found = []
    for i, line in enumerate(lines):
        if marker in line:
            for under in lines[i + 1 :]:
                if depth(under) <= depth(line):
                    break
                found.append(under)
    return found


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_areas_join_the_orders_not_the_lines(spark, small_broadcasts):
    small_broadcasts(-1)
    plan = plan_of(Tables(spark, "/root/testdata/sf0.001").payments)
    assert "l_orderkey" in plan and "hashpartitioning(o_custkey" in plan
    assert not [line for line in below(plan, "hashpartitioning(o_custkey") if "l_orderkey" in line]


def test_rows_meet_a_few_peer_groups_and_vendors_without_a_shuffle(spark, small_broadcasts):
    works = spark.range(3000).select(
        F.concat(F.lit("p"), "id").alias("project_id"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("c"), F.col("id") % 7)).alias("category"),
        F.lit("s").alias("state"), F.col("id").cast("double").alias("recommended_amount"), F.concat(F.lit("v"), F.col("id") % 3).alias("primary_vendor"),
    )
    payments = spark.range(30).select(
        F.concat(F.lit("v"), F.col("id") % 3).alias("vendor"), F.lit("d").alias("work_description"), F.lit(2.0).alias("expenditure_amount")
    )
    small_broadcasts(20_000)
    joined = features.with_vendor_statistics(features.with_peer_statistics(works), payments)
    assert "hashpartitioning" not in plan_of(joined)
    row = joined.where("project_id = 'p7'").first()  # no category: a group of its own
    assert (row["peer_mean_cost"], row["peer_median_cost"], row["vendor_total_expenditure"]) == (1498.0, 1498.0, 20.0)


def test_detectors_read_the_features_from_parquet(spark):
    """A row checkpoint holds all 30 columns uncompressed and is read whole."""
    for name in ("D09_cost_composite", "D13_delay_model"):
        plan = plan_of(load_all()[0][name](spark, "/root/testdata/sf0.001"))
        assert "ExistingRDD" not in plan and "vendor_project_count" not in plan


def test_alerts_compute_the_features_once(spark, monkeypatch):
    """Trends read their rows several times: for the sketch of the medians, the medians and the join."""
    made, read = [], Tables.read
    monkeypatch.setattr(Tables, "read", lambda self, name: made.append(name) or read(self, name))
    for name in ("E07_alerts", "E03_runaway_velocity"):
        out = load_all()[0][name](spark, "/root/testdata/sf0.001")
        plan = plan_of(out)
        assert made and "lineitem" not in plan and "l_orderkey" not in plan
        assert out.count() > 0
