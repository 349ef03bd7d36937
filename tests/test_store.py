"""Keyed stores of a stream: levels, bounded reads, repeated and broken batches."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.streaming import events, jobs
from ledgerlens.streaming.store import KeyedStore


def newest(rows):
    return rows.groupBy("k").agg(F.max_by("v", "__run").alias("v"))


def batch_of(spark, pairs):
    return spark.createDataFrame(pairs, "k string, v long").coalesce(1)


def files(frame):
    return 0 if frame is None else len(frame.inputFiles())


def test_reads_stay_bounded_and_the_newest_row_counts(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "k", newest, buckets=4, fanout=2)
    want, read, runs = {}, {}, {}
    for b in range(1, 26):
        pairs = [(f"k{b % 7}", b), (f"n{b}", b)]
        batch = batch_of(spark, pairs)
        touched = store.touched(batch)
        rows = store.read(store.runs(b), touched)
        read[b] = 0 if rows is None else len({f for f in rows.inputFiles() if any(f"__bucket={x}/" in f for x in touched)})
        store.append(batch, b)
        want.update(pairs)
        runs[b] = len(store.runs())
    assert {r["k"]: r["v"] for r in store.current().collect()} == want
    assert max(runs.values()) <= 5 and runs[16] == 1 and runs[24] == 2  # binary levels: one run for each bit
    assert read[25] <= read[12] and max(read.values()) <= 4 * 4
    # only the runs of the last two manifests are on disk
    assert len(os.listdir(tmp_path / "s/runs")) <= 10 and len([n for n in os.listdir(tmp_path / "s/manifest") if n.endswith(".json")]) == 2


def test_repeated_and_unfinished_batches(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "k", newest, buckets=2, fanout=2)
    assert store.current() is None and store.known(batch_of(spark, [("a", 1)]), 0) is None
    for b in (0, 1, 2):
        store.append(batch_of(spark, [("a", b), (f"x{b}", b)]), b)
    before = sorted(map(tuple, store.current().collect()))
    store.append(batch_of(spark, [("a", 2), ("x2", 2)]), 2)  # again, as after a lost driver
    assert sorted(map(tuple, store.current().collect())) == before
    # a batch that stops before its manifest is not seen, and its repeat starts from the batch before
    store._write(batch_of(spark, [("a", 99)]), "3-0", 0, 3)
    assert sorted(map(tuple, store.current().collect())) == before
    assert {r["k"]: r["v"] for r in store.known(batch_of(spark, [("a", 0)]), 3).collect()}["a"] == 2
    store.append(batch_of(spark, [("a", 7)]), 3)
    assert {r["k"]: r["v"] for r in store.current().collect()}["a"] == 7


def event(i, project, day, amount):
    return {
        "event_id": f"e{i}", "event_type": "PAYMENT_RECEIVED", "event_timestamp": f"2024-01-{day:02d}T00:00:00Z", "event_source": "historical_replay", "project_id": project,
        "mp_name": "M", "state": "S", "constituency": "C", "payment_status": "paid", "expenditure_amount": amount,
    }


@pytest.mark.parametrize("repeat", [False, True])
def test_states_of_many_batches_equal_one_fold(spark, tmp_path, repeat):
    schema = "event_id string, event_type string, event_timestamp string, event_source string, project_id string, mp_name string, state string, constituency string, payment_status string, expenditure_amount double, recommended_amount double, final_amount double, project_status string, completed_date string"
    rows = [event(i, f"P{i % 3}", 1 + (i * 7) % 28, float(i)) for i in range(12)] + [event(3, "P0", 4, 3.0)]
    out = str(tmp_path / "out")
    for b in range(0, len(rows), 3):
        batch = spark.createDataFrame(rows[b : b + 3], schema).coalesce(1)
        for _ in range(1 + repeat):
            jobs.store_states(batch, b // 3, out)
    whole = spark.createDataFrame(rows, schema).coalesce(1).withColumn("seq", F.monotonically_increasing_id())
    want = events.project_state(events.route_events(whole, "seq").where("event_status = 'processed'"))
    assert sorted(map(str, jobs.load_state(spark, out).collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        jobs.load_state(spark, str(tmp_path / "none"))
