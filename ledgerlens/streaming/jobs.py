"""Structured Streaming jobs over the event functions.

Accepted event ids and project states are kept in ``store.KeyedStore``: each micro-batch reads only the buckets that its ids and projects
fall into, however long the stream has run. A repeated batch overwrites itself. No event is dropped for being late and no id is ever
forgotten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.sources.files import write_jsonl
from ledgerlens.streaming.events import dashboard, finished_state, merge_partial, mp_state, partial_state, route_events
from ledgerlens.streaming.store import KeyedStore


def route_batch(batch: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Gate the events of one batch; repeats inside it, and of ids in ``seen`` (``event_id``), are duplicates with their reason."""
    routed = route_events(batch.withColumn("__order", F.monotonically_increasing_id()), "__order").drop("__order")
    if seen is None:
        return routed
    known = seen.select("event_id", F.lit(True).alias("__known"))
    again = (F.col("event_status") == "processed") & F.col("__known").isNotNull()
    return routed.join(known, "event_id", "left").withColumns(
        {
            "event_status": F.when(again, "duplicate").otherwise(F.col("event_status")),
            "reject_reason": F.when(again, "duplicate event_id").otherwise(F.col("reject_reason")),
        }
    ).drop("__known")


def id_store(spark: SparkSession, root: str) -> KeyedStore:
    """Ids of accepted events."""
    return KeyedStore(spark, root, "event_id", lambda rows: rows.groupBy("event_id").agg(F.min("__run").alias("__run")).drop("__run"))


def _newest_state(rows: DataFrame) -> DataFrame:
    columns = [c for c in rows.columns if c not in ("project_id", "__run")]
    return rows.groupBy("project_id").agg(F.max_by(F.struct(*columns), "__run").alias("s")).select("project_id", "s.*")


def state_store(spark: SparkSession, out: str) -> KeyedStore:
    """Partial states; a batch writes the whole partial state of each project that it touches, so the newest row counts."""
    return KeyedStore(spark, f"{out}/state", "project_id", _newest_state)


def _routed(batch: DataFrame, batch_id: int, out: str, name: str) -> tuple[DataFrame, KeyedStore]:
    """Write the routed batch to ``out/<name>/batch=<id>`` and return it with the store of ids, to which it has not been added yet."""
    spark = batch.sparkSession
    # the order of arrival is fixed by a file before ids are compared
    arrived = f"{out}/{name}-arrived/batch={batch_id}"
    batch.write.mode("overwrite").parquet(arrived)
    fixed = spark.read.schema(batch.schema).parquet(arrived)
    ids = id_store(spark, f"{out}/{name}-ids")
    routed = route_batch(fixed, ids.known(fixed, batch_id))
    routed.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
    return spark.read.schema(routed.schema).parquet(f"{out}/{name}/batch={batch_id}"), ids


def _accepted(routed: DataFrame) -> DataFrame:
    return routed.where("event_status = 'processed'")


def start_log(events: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Accepted events as JSON lines in ``out/events``, the others, duplicates included, with their reason in ``out/errors``."""

    def split(batch: DataFrame, batch_id: int) -> None:
        routed, ids = _routed(batch, batch_id, out, "log")
        write_jsonl(_accepted(routed).drop("event_status", "reject_reason"), f"{out}/events/batch={batch_id}")
        write_jsonl(routed.filter("event_status <> 'processed'"), f"{out}/errors/batch={batch_id}")
        ids.append(_accepted(routed).select("event_id"), batch_id)

    writer = events.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def store_states(batch: DataFrame, batch_id: int, out: str) -> None:
    """Merge the accepted events of one batch into the stored states of their projects."""
    routed, ids = _routed(batch, batch_id, out, "state-log")
    states = state_store(batch.sparkSession, out)
    fresh = partial_state(_accepted(routed))
    before = states.known(fresh, batch_id)
    if before is not None:
        touched = before.join(fresh.select("project_id"), "project_id", "left_semi")
        fresh = merge_partial(fresh.unionByName(touched))
    states.append(fresh, batch_id)
    ids.append(_accepted(routed).select("event_id"), batch_id)


def start_state(events: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep project states in ``out/state`` (``load_state``): each batch folds its accepted events into the projects that it touches.

    An event that arrives late takes its place by its own event time, however old it is.
    """
    writer = events.writeStream.foreachBatch(lambda batch, batch_id: store_states(batch, batch_id, out)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def load_state(spark: SparkSession, out: str) -> DataFrame:
    """State per project of the committed batches; raises if there is none yet."""
    found = state_store(spark, out).current()
    if found is None:
        raise ValueError(f"no batch is committed in {out}/state")
    return finished_state(found)


def load_mp_state(spark: SparkSession, out: str) -> DataFrame:
    return mp_state(load_state(spark, out))


def load_dashboard(spark: SparkSession, out: str) -> DataFrame:
    return dashboard(load_state(spark, out))
