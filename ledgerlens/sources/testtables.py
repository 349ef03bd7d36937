"""Roles on the driver's test tables (orders, lineitem, events, documents, ...).

The operators only see the roles: works, completions, payments, MP summaries, descriptions, project
events, votes, citizen reports, coordinates and hash items.  A few nulls are derived from the keys so
that the null paths are exercised on real table sizes.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import rounded

AS_OF = "2002-01-01"


def null_every(c: Column, key: str, n: int) -> Column:
    return F.when(F.col(key) % n != 0, c)


class Tables:
    """Lazily built role views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def areas(self) -> DataFrame:
        """Customers with their nation and region names."""
        return (
            self.read("customer")
            .join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("c_custkey").alias("o_custkey"),
                F.col("c_name").alias("mp_name"),
                F.col("c_mktsegment").alias("constituency"),
                F.col("n_name").alias("state"),
                F.col("r_name").alias("house"),
            )
        )

    @cached_property
    def works(self) -> DataFrame:
        return (
            self.read("orders")
            .join(self.areas, "o_custkey")
            .select(
                F.concat_ws("|", "o_orderkey", "mp_name", "constituency", "state").alias("project_id"),
                F.col("o_orderkey").cast("string").alias("work_id"),
                F.concat(F.col("o_orderpriority"), F.lit(" lot "), F.col("o_orderkey") % 4).alias("work_description"),
                null_every(F.col("o_orderpriority"), "o_orderkey", 53).alias("category"),
                "mp_name",
                "constituency",
                "state",
                "house",
                null_every(F.col("o_totalprice"), "o_orderkey", 67).alias("recommended_amount"),
                null_every(F.col("o_orderdate").cast("timestamp"), "o_orderkey", 61).alias("recommendation_date"),
                (F.col("o_orderkey") % 3 == 0).alias("has_images"),
                F.concat(F.lit("IDA-"), F.col("o_custkey") % 10).alias("ida"),
            )
        )

    @cached_property
    def completions(self) -> DataFrame:
        """Several completion records per finished work; the last one counts."""
        done = self.read("orders").filter("o_orderstatus = 'F'").select("o_orderkey")
        # the amount is worked out before the join: one column less to shuffle
        lines = self.read("lineitem").select(
            "l_orderkey",
            rounded(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).alias("final_amount"),
            "l_shipdate",
            "l_linenumber",
        )
        return lines.join(done, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_orderkey").cast("string").alias("work_id"),
            "final_amount",
            F.col("l_shipdate").cast("timestamp").alias("completed_date"),
            (F.col("l_linenumber") % 5 + 1).cast("double").alias("average_rating"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        """Payment records know the work only by MP, constituency, state and a loosely written description."""
        # areas join the orders, not the several times more lines
        placed = self.read("orders").join(self.areas, "o_custkey")
        return (
            self.read("lineitem")
            .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                "mp_name",
                "constituency",
                "state",
                "house",
                F.concat(F.col("o_orderpriority"), F.lit(" -- LOT #"), F.col("o_orderkey") % 4).alias("work_description"),
                F.col("s_name").alias("vendor"),
                F.concat(F.lit("IDA-"), F.col("o_custkey") % 10).alias("ida"),
                F.col("l_extendedprice").alias("expenditure_amount"),
                F.col("l_shipdate").cast("timestamp").alias("expenditure_date"),
                F.when(F.col("l_returnflag") == "A", "successful")
                .when(F.col("l_returnflag") == "N", "pending")
                .otherwise("cancelled")
                .alias("payment_status"),
            )
        )

    @cached_property
    def mp_summary(self) -> DataFrame:
        price = F.col("o_totalprice").cast("decimal(18,2)")
        finished = F.col("o_orderstatus") == "F"
        totals = (
            self.read("orders")
            .groupBy("o_custkey")
            .agg(
                F.sum(price).cast("double").alias("allocated_amount"),
                F.sum(F.when(F.col("o_orderstatus") != "O", price)).cast("double").alias("spent"),
                F.count_if(finished).alias("completed_works"),
                F.count("*").alias("recommended_works"),
                F.count_if(F.col("o_orderstatus") == "P").alias("pending_payments"),
                F.sum(F.col("o_orderkey") % 5 + 1).alias("rating_sum"),
            )
        )
        return totals.join(self.areas, "o_custkey").select(
            "mp_name",
            "constituency",
            "state",
            "house",
            "allocated_amount",
            rounded(F.coalesce("spent", F.lit(0.0)) * 1.3, 2).alias("total_expenditure"),
            rounded(F.coalesce("spent", F.lit(0.0)) * 130.0 / F.col("allocated_amount"), 4).alias("utilization_pct"),
            "completed_works",
            "recommended_works",
            rounded(F.col("completed_works") * 100.0 / F.col("recommended_works"), 4).alias("completion_rate_pct"),
            rounded(F.col("allocated_amount") - F.coalesce("spent", F.lit(0.0)) * 1.3, 2).alias("unspent_amount"),
            F.col("recommended_works").alias("transaction_count"),
            F.col("completed_works").alias("successful_payments"),
            "pending_payments",
            rounded(F.col("rating_sum") / F.col("recommended_works"), 2).alias("average_rating"),
        )

    @cached_property
    def descriptions(self) -> DataFrame:
        """Documents as work descriptions, whole texts."""
        return self.read("documents").select(
            F.concat_ws("|", "doc_id", F.concat(F.lit("MP "), F.col("doc_id") % 50), "source", "lang").alias("project_id"),
            F.col("text").alias("work_description"),
            F.concat(F.lit("cat"), F.col("doc_id") % 4).alias("category"),
            F.col("lang").alias("state"),
            F.col("source").alias("constituency"),
            F.concat(F.lit("MP "), F.col("doc_id") % 50).alias("mp_name"),
            ((F.col("doc_id") * 7919) % 9000 + 1000).cast("double").alias("recommended_amount"),
        )

    @cached_property
    def project_events(self) -> DataFrame:
        """The event stream as project events; every 40th event repeats an earlier id."""
        kind = F.col("event_type")
        n = F.col("event_id")
        k = F.get_json_object("props", "$.k")
        return self.read("events").select(
            F.concat(F.lit("ev-"), F.when(n % 40 == 39, n - 1).otherwise(n)).alias("event_id"),
            F.when(kind == "signup", "project_recommended")
            .when(kind == "purchase", "PAYMENT_RECEIVED")
            .when(kind == "click", "PAYMENT_STATUS_UPDATED")
            .when(kind == "view", "PROJECT_STATUS_UPDATED")
            .otherwise("PROJECT_COMPLETED")
            .alias("event_type"),
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("event_timestamp"),
            F.when(n % 97 == 0, "unknown_feed").otherwise("historical_replay").alias("event_source"),
            k.alias("project_id"),
            F.when(n % 83 != 0, F.concat(F.lit("MP "), k.cast("long") % 7)).alias("mp_name"),
            F.concat(F.lit("State "), k.cast("long") % 4).alias("state"),
            F.concat(F.lit("Area "), k.cast("long") % 11).alias("constituency"),
            F.when(kind == "signup", F.col("value")).alias("recommended_amount"),
            F.when(kind == "purchase", F.when(n % 71 == 0, -F.col("value")).otherwise(F.col("value"))).alias(
                "expenditure_amount"
            ),
            F.when(kind == "error", F.col("value")).alias("final_amount"),
            F.when(
                kind.isin("purchase", "click"),
                F.element_at(
                    F.array(*[F.lit(s) for s in ("Payment Success", "payment in-progress", "Pending", "bounced", "cancelled")]),
                    (F.when(n % 50 == 0, 3).otherwise(n % 3) + 1).cast("int"),
                ),
            ).alias("payment_status"),
            F.when(kind == "view", F.when(F.col("user_id") % 2 == 0, "in_progress").otherwise("on_hold")).alias(
                "project_status"
            ),
            F.when(kind == "error", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")).alias("completed_date"),
            F.when(n % 59 == 0, "ambiguous").when(n % 61 == 0, "unresolved").otherwise("resolved").alias("mapping_status"),
            n.alias("seq"),
        )

    @cached_property
    def vote_actions(self) -> DataFrame:
        """Vote toggles: clicks and views by a citizen on a work."""
        n = F.col("event_id")
        return (
            self.read("events")
            .filter("event_type in ('click', 'view')")
            .select(
                n.alias("action_id"),
                F.col("user_id").alias("citizen_id"),
                F.get_json_object("props", "$.k").alias("work_id"),
                F.when(n % 4 != 0, self._tags(n)).alias("reasons"),
            )
        )

    @staticmethod
    def _tags(n: Column) -> Column:
        words = F.array(*[F.lit(s) for s in ("stalled", "quality", "cost", "ghost", "other", "noise")])
        one = F.element_at(words, (n % 6 + 1).cast("int"))
        two = F.element_at(words, (n % 5 + 1).cast("int"))
        return F.when(n % 6 == n % 5, F.to_json(F.array(one))).otherwise(F.to_json(F.array(one, two)))

    @cached_property
    def citizen_reports(self) -> DataFrame:
        n = F.col("event_id")
        return (
            self.read("events")
            .filter("event_type = 'error'")
            .select(
                n.alias("report_id"),
                F.col("user_id").alias("citizen_id"),
                F.get_json_object("props", "$.k").alias("work_id"),
                self._tags(n).alias("criteria"),
                F.when(n % 3 != 0, (n % 7).cast("long")).alias("satisfaction"),
                F.concat(F.lit("note "), n).alias("comment"),
            )
        )

    @cached_property
    def civic_works(self) -> DataFrame:
        """Works that citizens act on: the first customers' areas, keyed like the event payload."""
        n = F.col("c_custkey")
        return (
            self.read("customer")
            .join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                n.cast("string").alias("work_id"),
                F.col("c_name").alias("mp_name"),
                F.col("c_mktsegment").alias("constituency"),
                F.col("n_name").alias("state"),
                F.concat(F.lit("Work of "), F.col("c_name")).alias("work_description"),
                F.abs(F.col("c_acctbal")).alias("recommended_amount"),
                ((n * 7919) % 10001 / 10000.0).alias("overall_risk_score"),
            )
            .withColumn("risk_category", risk_band(F.col("overall_risk_score")))
        )

    @cached_property
    def report_actions(self) -> DataFrame:
        """Routed reports as an action log: created, acknowledged, cleared."""
        n = F.col("event_id")
        return (
            self.read("events")
            .filter("event_type in ('purchase', 'signup', 'error')")
            .select(
                n.alias("action_id"),
                F.when(F.col("event_type") == "purchase", n).otherwise(F.col("user_id") * 13 % 2000).alias("report_id"),
                F.when(F.col("event_type") == "purchase", "CREATE")
                .when(F.col("event_type") == "signup", "ACK")
                .otherwise("CLEAR")
                .alias("action"),
                F.get_json_object("props", "$.k").alias("work_id"),
                F.element_at(
                    F.array(
                        *[
                            F.lit(s)
                            for s in ("MP", "District Magistrate", "State Nodal Officer", "MoSPI Audit Cell", "Nobody")
                        ]
                    ),
                    (n % 5 + 1).cast("int"),
                ).alias("target_role"),
                F.when(n % 2 == 0, F.concat(F.lit("see "), n)).alias("comment"),
                F.when(n % 3 == 0, F.lit("{}")).alias("snapshot"),
            )
        )

    @cached_property
    def coordinates(self) -> DataFrame:
        """Suppliers and customers on a small grid near the equator, some without coordinates."""
        from_customer = self.read("customer").select(
            F.concat(F.lit("C"), "c_custkey").alias("project_id"),
            F.col("c_custkey").alias("n"),
            F.col("c_nationkey").alias("s"),
            F.col("c_mktsegment").alias("constituency"),
        )
        from_supplier = self.read("supplier").select(
            F.concat(F.lit("S"), "s_suppkey").alias("project_id"),
            F.col("s_suppkey").alias("n"),
            F.col("s_nationkey").alias("s"),
            F.lit("SUPPLY").alias("constituency"),
        )
        n = F.col("n")
        return from_customer.unionByName(from_supplier).select(
            "project_id",
            F.concat(F.lit("NATION_"), "s").alias("state"),
            "constituency",
            null_every(10.0 + (n * 7919 % 4001) / 2000.0, "n", 23).alias("latitude"),
            null_every(70.0 + (n * 104729 % 6007) / 2000.0, "n", 23).alias("longitude"),
            (n % 17 == 0).alias("location_is_synthetic"),
            F.when(n % 5 == 0, "real").when(n % 5 == 1, "Official_Source").otherwise("manual").alias("location_source"),
            (n % 7 == 0).alias("is_verified"),
        )

    @cached_property
    def hash_items(self) -> DataFrame:
        """A 64-bit hash per embedding from the signs of its first 64 numbers.

        Each item is also handed in by the next label's project and once more by its own, with up to 6
        and 8 of the lowest bits flipped.
        """
        sign = F.transform(
            F.sequence(F.lit(1), F.lit(64)),
            lambda i: F.when(F.element_at("embedding", i) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")),
        )
        bits = F.aggregate(sign, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))
        n = F.col("vec_id")
        versions = F.array(
            *[
                F.struct(
                    (n + shift).alias("item_id"),
                    project.cast("string").alias("project_id"),
                    bits.bitwiseXOR(F.expr(f"shiftleft(1L, cast(vec_id % {flips} as int)) - 1")).alias("item_hash"),
                )
                for shift, project, flips in (
                    (0, F.col("label"), 1),
                    (1_000_000_000, F.col("label") + 1, 7),
                    (2_000_000_000, F.col("label"), 9),
                )
            ]
        )
        return self.read("embeddings").select(F.inline(versions))

    @cached_property
    def risk(self) -> DataFrame:
        """A finished risk table with scores that follow from the keys, for the query layer."""
        n = F.col("o_orderkey")
        part = lambda mul: (n * mul % 10001) / 10000.0
        base = (
            self.read("orders")
            .join(self.areas, "o_custkey")
            .select(
                F.concat_ws("|", "o_orderkey", "mp_name", "constituency", "state").alias("project_id"),
                n.cast("string").alias("work_id"),
                "mp_name",
                "state",
                "constituency",
                "house",
                null_every(F.col("o_orderpriority"), "o_orderkey", 53).alias("category"),
                F.concat(F.col("o_orderpriority"), F.lit(" lot "), n % 4).alias("work_description"),
                F.when(F.col("o_orderstatus") == "F", "completed").otherwise("in_progress").alias("status"),
                (F.col("o_orderstatus") == "F").cast("long").alias("is_completed"),
                F.col("o_totalprice").alias("recommended_amount"),
                rounded(F.col("o_totalprice") * ((n * 37) % 150) / 100.0, 2).alias("total_expenditure"),
                rounded(((n * 37) % 150) / 100.0, 4).alias("expenditure_ratio"),
                part(7919).alias("overall_risk_score"),
                part(31).alias("cost_risk_score"),
                F.when(n % 11 != 0, part(57)).alias("delay_risk_score"),
                part(91).alias("payment_risk_score"),
                part(113).alias("rule_risk_score"),
                F.when(n % 13 == 0, part(131)).alias("similarity_risk_score"),
                part(171).alias("iforest_risk_score"),
                F.concat(
                    F.element_at(F.array(F.lit("Cost"), F.lit("Delay"), F.lit("Payment")), (n % 3 + 1).cast("int")),
                    F.lit(" (Score: 0.50, Weight: 60.0%); "),
                    F.element_at(F.array(F.lit("Rule"), F.lit("Iforest")), (n % 2 + 1).cast("int")),
                    F.lit(" (Score: 0.40, Weight: 40.0%)"),
                ).alias("top_risk_signals"),
            )
            .withColumn("risk_category", risk_band(F.col("overall_risk_score")))
        )
        engines = ["cost", "delay", "payment", "rule", "similarity", "iforest"]
        score = {e: F.col(f"{e}_risk_score") for e in engines}
        return base.withColumns(
            {f"{e}_available": score[e].isNotNull() for e in engines}
            | {f"{e}_risk_flag": F.coalesce(score[e] >= 0.5, F.lit(False)) for e in engines}
        )


def risk_band(score: Column) -> Column:
    return F.when(score >= 0.8, "CRITICAL").when(score >= 0.6, "HIGH").when(score >= 0.3, "MEDIUM").otherwise("LOW")
