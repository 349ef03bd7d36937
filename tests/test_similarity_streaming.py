"""Brute-force comparisons on small data, hot keys, and stream parity."""

import itertools
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import blocking, fusion, geo, hashes, similarity
from ledgerlens.sources import files
from ledgerlens.streaming import events, jobs

TEXTS = {
    "P001|M1|C1|S1": "construction of boundary wall at government primary school rampur block seven",
    "P002|M2|C1|S1": "construction of boundary wall at government primary school rampur block seven",
    "P003|M1|C2|S1": "supply of water tanker for village panchayat lakhanpur with trolley and pipe",
    "P004|M3|C2|S1": "supply of water tanker for village panchayat lakhanpur with trolley and hose",
    "P005|M1|C3|S2": "installation of solar street lighting along the eastern canal embankment",
    "P006|M4|C3|S2": "cc road",
    "P007|M4|C3|S2": "cc road",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, v, k.split("|")[3], k.split("|")[2]) for k, v in TEXTS.items()]
    df = spark.createDataFrame(rows, "project_id string, work_description string, state string, constituency string")
    return similarity.with_clean_descriptions(df)


def test_pairs_match_brute_force(spark, docs):
    texts = similarity.distinct_texts(docs)
    model = similarity.fit_tfidf(texts, similarity.STOP_WORDS)
    vectors = {}
    for r in model.weights.collect():
        vectors.setdefault(r["text_id"], {})[r["term"]] = r["weight"]
    for t in (0.1, 0.5, 0.85):
        want = {}
        for a, b in itertools.combinations(sorted(vectors), 2):
            dot = sum(w * vectors[b].get(term, 0.0) for term, w in vectors[a].items())
            if dot >= t:
                want[(a, b)] = round(dot, 9)
        got = {(r["text_id_a"], r["text_id_b"]): round(r["similarity"], 9) for r in similarity.cosine_pairs(model.vectors, t).collect()}
        assert got == want


def test_scores_and_pairs(spark, docs):
    texts = similarity.distinct_texts(docs)
    model = similarity.fit_tfidf(texts, similarity.STOP_WORDS)
    pairs = similarity.cosine_pairs(model.vectors, 0.5)
    shown = similarity.text_pairs(docs, pairs, texts).collect()
    found = {(r["project_id_a"][:4], r["project_id_b"][:4]): r for r in shown}
    assert ("P001", "P001") in found and found[("P001", "P001")]["copies_a"] == 2  # P001 and P002 share a text
    assert ("P006", "P006") in found and not any("P005" in k for k in found)
    scores = {r["project_id"][:4]: r["similarity_anomaly_score"] for r in similarity.duplicate_scores(docs, texts, pairs).collect()}
    assert scores["P006"] <= 0.05 and scores["P007"] <= 0.05 and scores["P001"] > 0
    related = similarity.related_projects("P002|M2|C1|S1", docs, texts, model, 0.5).collect()
    assert [(r["other_id"][:4], r["similarity_score"]) for r in related] == [("P001", 1.0)]


def test_blocked_pairs_cover_a_hot_key(spark):
    rows = [("hot", i) for i in range(60)] + [("cold", 100), ("cold", 101)]
    df = spark.createDataFrame(rows, "k string, id int")
    got = [(r["id_a"], r["id_b"]) for r in blocking.blocked_pairs(df, ["k"], "id", [], size=7).collect()]
    want = list(itertools.combinations(range(60), 2)) + [(100, 101)]
    assert sorted(got) == sorted(want)
    left = spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3)], "k string, q int")
    met = blocking.blocked_lookup(left, df, ["k"], F.col("id"), size=7).groupBy("q").count().collect()
    assert {r["q"]: r["count"] for r in met} == {1: 60, 2: 2}
    many = spark.createDataFrame([("hot", i) for i in range(500)], "k string, q int")
    joined = blocking.blocked_lookup(many, many.withColumnRenamed("q", "id"), ["k"], F.col("id"), size=50)
    assert joined.count() == 250_000 and joined.distinct().count() == 250_000
    blocks = blocking.hot_keys(many, ["k"], "n", 50).first()
    assert blocks["n"] == 10


def test_hash_pairs_match_brute_force(spark):
    import random

    r = random.Random(5)
    base = [r.getrandbits(63) for _ in range(12)]
    rows = []
    for i, b in enumerate(base):
        for j in range(4):
            flipped = b
            for bit in r.sample(range(63), r.randint(0, 7)):
                flipped ^= 1 << bit
            rows.append((i * 10 + j, str((i + j) % 3), flipped))
    df = spark.createDataFrame(rows, "item_id int, project_id string, item_hash long")
    got = {(r["item_hash_a"], r["item_hash_b"]) for r in hashes.cross_project_duplicates(df).filter("hamming > 0").collect()}
    projects = {}
    for _, p, h in rows:
        projects.setdefault(h, set()).add(p)
    want = {
        (a, b)
        for a, b in itertools.combinations(sorted(projects), 2)
        if bin(a ^ b).count("1") <= 5 and len(projects[a] | projects[b]) > 1
    }
    assert got == want


def test_hash_pairs_of_crowded_keys(spark, monkeypatch):
    """Many hashes share most bits, so that every key is crowded and cut again."""
    import random

    monkeypatch.setattr(hashes, "CROWD", 20)
    r = random.Random(6)
    base, found = r.getrandbits(62), set()
    while len(found) < 120:
        flipped = base
        for bit in r.sample(range(63), r.randint(0, 6)):
            flipped ^= 1 << bit
        found.add(flipped)
    rows = [(i, str(i % 7), h) for i, h in enumerate(sorted(found))]
    df = spark.createDataFrame(rows, "item_id int, project_id string, item_hash long")
    got = {(x["item_hash_a"], x["item_hash_b"]) for x in hashes.cross_project_duplicates(df).filter("hamming > 0").collect()}
    project = {h: p for _, p, h in rows}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(project), 2) if bin(a ^ b).count("1") <= 5 and project[a] != project[b]}


def haversine(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(x))


def test_proximity_matches_brute_force(spark):
    import random

    r = random.Random(9)
    points = {f"A{i}": (r.uniform(28.5, 28.7), r.uniform(77.0, 77.3)) for i in range(60)}
    points |= {f"B{i}": (28.6, 77.1) for i in range(5)}  # one shared site
    points |= {"NORTH": (82.0, 10.0), "NORTH2": (82.01, 10.2), "EAST": (10.0, 179.99), "WEST": (10.0, -179.99), "ALONE": (-60.0, -100.0)}
    rows = [(k, lat, lon, "s", "c" if k[0] in "AB" else "d") for k, (lat, lon) in points.items()]
    df = spark.createDataFrame(rows, "project_id string, latitude double, longitude double, state string, constituency string")
    got = {x["project_id"]: x for x in geo.proximity_features(df, df).collect()}
    for k, at in points.items():
        others = {o: haversine(at, b) for o, b in points.items() if o != k}
        assert got[k]["nearest_project_distance_km"] == pytest.approx(min(others.values()), abs=1e-6), k
        assert got[k]["nearby_projects_5km"] == sum(d <= 5 for d in others.values()), k
        assert got[k]["nearby_projects_500m"] == sum(d <= 0.5 for d in others.values()), k
        same = [d for o, d in others.items() if (o[0] in "AB") == (k[0] in "AB")]
        assert got[k]["nearest_same_constituency_distance_km"] == pytest.approx(min(same), abs=1e-6), k


def test_pair_aggregate(spark):
    rows = [("P1", "P2", 0.95, 0.88, 1, "CRITICAL_GEO"), ("P2", "P3", 0.86, 0.5, 0, "HIGH_GEO")]
    df = spark.createDataFrame(rows, "project_id_a string, project_id_b string, similarity_score double, pair_risk_score double, exact_text_duplicate_flag int, geo_risk_label string")
    p2 = {r["project_id"]: r for r in fusion.aggregate_pairs(df).collect()}["P2"]
    assert (p2["pair_duplicate_count"], p2["max_pair_similarity_score"], p2["max_pair_risk_score"]) == (2, 0.95, 0.88)
    assert p2["pair_exact_text_flag"] == 1 and p2["pair_critical_geo_flag"] == 1


def sample_events():
    base = {"event_source": "historical_replay", "mp_name": "M", "state": "S", "constituency": "C"}
    at = lambda h: f"2024-01-01T{h:02d}:00:00Z"
    return [
        base | {"event_id": "e1", "event_type": "project_recommended", "event_timestamp": at(1), "project_id": "P", "recommended_amount": 100.0},
        base | {"event_id": "e2", "event_type": "PAYMENT_RECEIVED", "event_timestamp": at(2), "project_id": "P", "expenditure_amount": 40.0, "payment_status": "Payment Success"},
        base | {"event_id": "e3", "event_type": "PAYMENT_STATUS_UPDATED", "event_timestamp": at(4), "project_id": "P", "payment_status": "pending"},
        base | {"event_id": "e4", "event_type": "PAYMENT_RECEIVED", "event_timestamp": at(3), "project_id": "P", "expenditure_amount": 10.0, "payment_status": "paid"},
        base | {"event_id": "e5", "event_type": "PROJECT_COMPLETED", "event_timestamp": at(5), "project_id": "Q", "final_amount": 7.0, "completed_date": "2024-01-01"},
        base | {"event_id": "e6", "event_type": "PAYMENT_RECEIVED", "event_timestamp": at(6), "project_id": "P", "expenditure_amount": -1.0},
        base | {"event_id": "e7", "event_type": "PAYMENT_RECEIVED", "event_timestamp": at(6), "project_id": "U", "mapping_status": "unresolved"},
        base | {"event_id": "e2", "event_type": "PAYMENT_RECEIVED", "event_timestamp": at(2), "project_id": "P", "expenditure_amount": 40.0, "payment_status": "Payment Success"},
    ]


def write_log(folder, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/log.jsonl", "w") as f:
        f.write("\n".join([json.dumps(r) for r in rows] + ["", "{broken"]))


def test_routing_and_fold(spark, tmp_path):
    write_log(tmp_path, sample_events())
    log = files.read_event_log(spark, str(tmp_path)).coalesce(1).withColumn("seq", F.monotonically_increasing_id())
    routed = events.route_events(log, "seq")
    assert {r["event_status"]: r["events"] for r in events.status_counts(routed).collect()} == {"processed": 5, "invalid": 1, "skipped": 1, "duplicate": 1}
    state = {r["project_id"]: r for r in events.project_state(routed.filter("event_status = 'processed'")).collect()}
    p = state["P"]
    assert (p["total_expenditure"], p["payment_count"], p["latest_payment_status"], p["current_status"]) == (50.0, 2, "pending", "recommended")
    assert state["Q"]["current_status"] == "completed" and state["Q"]["final_amount"] == 7.0


def test_stream_state_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_log(source, sample_events())
    stream = files.stream_event_log(spark, source)
    jobs.start_state(stream, out, str(tmp_path / "cp"), once=True).awaitTermination()
    live = {r["project_id"]: r.asDict() for r in jobs.load_state(spark, out).collect()}
    log = files.read_event_log(spark, source).coalesce(1).withColumn("seq", F.monotonically_increasing_id())
    batch = events.project_state(events.route_events(log, "seq").filter("event_status = 'processed'"))
    assert live == {r["project_id"]: r.asDict() for r in batch.collect()}
    logs = str(tmp_path / "logs")
    jobs.start_log(files.stream_event_log(spark, source), logs, str(tmp_path / "cp2"), once=True).awaitTermination()
    assert spark.read.json(f"{logs}/events").count() == 5  # the repeated e2 is an error
    errors = [r["event_status"] for r in spark.read.json(f"{logs}/errors").collect()]
    assert sorted(errors) == ["duplicate", "invalid", "skipped"]


def test_late_and_repeated_events_over_batches(spark, tmp_path):
    """A payment two months late counts, and an id that returns weeks later doesn't."""
    base = {"event_source": "historical_replay", "mp_name": "M", "state": "S", "constituency": "C", "project_id": "P", "event_type": "PAYMENT_RECEIVED", "payment_status": "paid"}
    days = [("a", "2024-03-02", 10.0), ("b", "2024-01-02", 20.0), ("c", "2024-03-25", 5.0), ("a", "2024-03-02", 10.0)]
    source, out, logs = (str(tmp_path / x) for x in ("in", "out", "logs"))
    for i, (name, day, amount) in enumerate(days):
        os.makedirs(source, exist_ok=True)
        with open(f"{source}/{i}.jsonl", "w") as f:
            f.write(json.dumps(base | {"event_id": name, "event_timestamp": f"{day}T00:00:00Z", "expenditure_amount": amount}))
        jobs.start_state(files.stream_event_log(spark, source), out, str(tmp_path / "cp"), once=True).awaitTermination()
        jobs.start_log(files.stream_event_log(spark, source), logs, str(tmp_path / "cp2"), once=True).awaitTermination()
    (p,) = jobs.load_state(spark, out).collect()
    assert (p["total_expenditure"], p["payment_count"], p["latest_event_timestamp"][:10]) == (35.0, 3, "2024-03-25")
    assert spark.read.json(f"{logs}/events").count() == 3
    assert [r["reject_reason"] for r in spark.read.json(f"{logs}/errors").collect()] == ["duplicate event_id"]
    assert jobs.load_mp_state(spark, out).first()["expenditure_total"] == 35.0


def test_registry_strictness(spark, tmp_path):
    registry = files.DatasetRegistry(spark, str(tmp_path))
    assert registry.load_table("agency_profiles") is None
    with pytest.raises(FileNotFoundError):
        registry.load_table("base_projects")
    with pytest.raises(KeyError):
        registry.load_table("nothing", strict=True)


def test_terms_are_counted_in_the_row_of_their_text(spark, monkeypatch):
    rows = [("x", 1, "Canal the wall canal wall canal"), ("x", 1, "e f"), ("y", 1, None), ("z", 2, "of the"), (None, 1, "p q p q"), ("x", 2, "e f"), ("long", 1, "a b " * 300)]
    stop = ["the", "of"]
    want = {}
    for text_id, copies, text in rows:
        words = [w for w in (text or "").lower().split() if w not in stop]
        for n in (1, 2, 3):
            for i in range(len(words) - n + 1):
                key = (text_id, copies, " ".join(words[i : i + n]))
                want[key] = want.get(key, 0) + 1
    texts = spark.createDataFrame(rows, "text_id string, copies long, text string").repartition(2)
    for limit in (3, 1 << 17):
        monkeypatch.setattr(similarity, "WORDS", limit)
        counts = similarity.term_counts(texts, stop, 3)
        got = [(r.text_id, r.copies, r.term, r.tf) for r in counts.collect()]
        assert {k[:3]: k[3] for k in got} == want and len(got) == len(want)
    # a text's n-grams are not made one row each before they are counted
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()
