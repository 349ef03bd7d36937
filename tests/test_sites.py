"""Nearest sites and counts in the cell hierarchy against brute force, with leaves of a few sites."""

import math
import random

import numpy as np
import pytest

from ledgerlens.operators import geo, sites


def haversine(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(x)))


def spread(rng):
    """Clusters, poles, the date line, lone points and shared places."""
    out = [(rng.uniform(28.4, 28.8), rng.uniform(77.0, 77.4)) for _ in range(150)]
    out += [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(80)]
    out += [(rng.uniform(88, 90), rng.uniform(-180, 180)) for _ in range(25)] + [(rng.uniform(-1, 1), rng.choice([-1, 1]) * rng.uniform(179.5, 180)) for _ in range(40)]
    out += [(28.6, 77.2)] * 9 + [(90.0, 0.0), (-90.0, 50.0), (0.0, 180.0), (0.0, -180.0), (28.6 + 1e-7, 77.2)]
    return out


@pytest.mark.parametrize("leaf", [3, 20])
def test_hierarchy_equals_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(sites, "LEAF", leaf)
    rng = random.Random(leaf)
    points = {f"P{i:04d}": at for i, at in enumerate(spread(rng))}
    area = {k: rng.choice(["a", "a", "a", "b", None]) for k in points}
    rows = [(k, lat, lon, "s", area[k]) for k, (lat, lon) in points.items()] + [("none", None, 1.0, "s", "a")]
    df = spark.createDataFrame(rows, "project_id string, latitude double, longitude double, state string, constituency string").repartition(5)
    got = {x["project_id"]: x for x in geo.proximity_features(df, df).collect()}
    assert len(got) == len(rows) and got["none"]["location_data_available"] is False
    for k, at in points.items():
        far = {o: haversine(at, b) for o, b in points.items() if o != k}
        x = got[k]
        assert x["nearest_project_distance_km"] == pytest.approx(min(far.values()), abs=1e-6), k
        assert far[x["nearest_project_id"]] == pytest.approx(min(far.values()), abs=1e-6)
        for name, r in (("nearby_projects_500m", 0.5), ("nearby_projects_1km", 1.0), ("nearby_projects_5km", 5.0)):
            assert x[name] == sum(d <= r for d in far.values()), (k, name)
        same = [d for o, d in far.items() if area[o] == area[k] and area[k] is not None]
        assert x["nearest_same_constituency_distance_km"] == (pytest.approx(min(same), abs=1e-6) if same else None), k


def test_places_shared_by_many_and_lone_points(spark):
    rows = [(f"A{i}", 1.0, 2.0) for i in range(50)] + [("B", 1.0, 2.001)]
    df = spark.createDataFrame(rows, "project_id string, latitude double, longitude double")
    near = {r["__id"]: (r["__near_id"], r["__near_km"]) for r in geo.nearest_site(df, []).collect()}
    assert near["A0"] == ("A1", 0.0) and near["A7"] == ("A0", 0.0) and near["B"][0] == "A0" and near["B"][1] == pytest.approx(haversine((1, 2), (1, 2.001)))
    assert geo.nearest_site(df.where("project_id = 'B'"), []).collect() == [] and geo.nearest_site(df.limit(0), []).collect() == []


def test_box_bounds_hold():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        lat, lon = rng.uniform(-90, 90), rng.uniform(-180, 180)
        a, b = np.sort(rng.uniform(-90, 90, 2)), np.sort(rng.uniform(-180, 180, 2))
        if rng.random() < 0.7:
            a[1], b[1] = min(90, a[0] + rng.uniform(0, 1)), min(180, b[0] + rng.uniform(0, 2))
        low, high = sites.box_bounds(np.array([lat]), np.array([lon]), [np.array([x]) for x in (*a, *b)])
        inside = sites.distance_km(lat, lon, rng.uniform(*a, 300), rng.uniform(*b, 300))
        corners = sites.distance_km(lat, lon, a[[0, 0, 1, 1]], b[[0, 1, 0, 1]])
        assert low[0] <= min(inside.min(), corners.min()) and high[0] >= max(inside.max(), corners.max())


def test_python_holds_few_lists_at_a_time(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(sites, "LEAF", 4)
    monkeypatch.setattr(sites, "HELD", 64)
    for name in ("_in_leaves", "_answered"):

        def counted(radii, of=getattr(sites, name)):
            def run(parts):
                for x in parts:
                    seen.add(int(sum(len(v) for v in x.column("held").to_pylist()) > 400))
                    yield from of(radii)(iter([x]))

            return run

        monkeypatch.setattr(sites, name, counted)
    rng = random.Random(9)
    at = [(rng.uniform(10, 11), rng.uniform(70, 71)) for _ in range(1500)]
    rows = [(i, 0, lat, lon, 1, f"P{i:04d}") for i, (lat, lon) in enumerate(at)]
    df = spark.createDataFrame(rows, "site long, area long, lat double, lon double, n long, low string").repartition(2)
    got = {x["site"]: x for x in sites.nearest_sites(df, [3.0]).collect()}
    assert len(got) == len(rows) and seen.value == 0
    for i in range(0, 1500, 100):
        far = [haversine(at[i], b) for b in at]
        assert got[i]["km"] == pytest.approx(min(far[:i] + far[i + 1 :]), abs=1e-6)
        assert list(got[i]["counts"]) == [sum(x <= 3.0 for x in far)]
