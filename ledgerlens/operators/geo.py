"""Administrative and geographic proximity."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import any_of, clip_or_null, rounded
from ledgerlens.functions.text import lookup
from ledgerlens.operators.quality import melt
from ledgerlens.operators.ranking import keep_first
from ledgerlens.operators.sites import nearest_sites
from ledgerlens.session import materialize

# Weights and labels of the administrative relationships.
GEO_WEIGHT = {"SAME_CONSTITUENCY": 1.0, "SAME_STATE_DIFF_CONST": 0.7, "DIFF_STATE": 0.4, "UNKNOWN": 0.5}
GEO_LABEL = {
    "SAME_CONSTITUENCY": "CRITICAL_GEO",
    "SAME_STATE_DIFF_CONST": "HIGH_GEO",
    "DIFF_STATE": "MEDIUM_GEO",
    "UNKNOWN": "LOW_GEO",
}
# Coarse boxes (lat_min, lat_max, lon_min, lon_max) per state.
STATE_BOXES = {
    "punjab": (29.5, 32.6, 73.8, 76.9),
    "haryana": (27.6, 30.9, 74.4, 77.6),
    "rajasthan": (23.0, 30.2, 69.4, 78.3),
    "uttar pradesh": (23.8, 30.4, 77.0, 84.7),
    "bihar": (24.3, 27.5, 83.3, 88.3),
    "maharashtra": (15.6, 22.1, 72.6, 80.9),
    "gujarat": (20.1, 24.7, 68.1, 74.5),
    "madhya pradesh": (21.0, 26.9, 74.0, 82.8),
    "karnataka": (11.6, 18.5, 74.0, 78.6),
    "kerala": (8.2, 12.8, 74.8, 77.4),
    "tamil nadu": (8.0, 13.6, 76.2, 80.4),
    "andhra pradesh": (12.6, 19.9, 76.7, 84.8),
    "telangana": (15.8, 19.9, 77.2, 81.8),
    "odisha": (17.7, 22.6, 81.3, 87.6),
    "west bengal": (21.4, 27.2, 85.8, 89.9),
    "assam": (24.0, 28.0, 89.6, 96.1),
    "jharkhand": (21.9, 25.3, 83.3, 87.9),
    "chhattisgarh": (17.7, 24.1, 80.2, 84.4),
    "uttarakhand": (28.7, 31.5, 77.3, 81.1),
    "himachal pradesh": (30.3, 33.3, 75.5, 79.0),
}
EARTH_KM = 6371.0
UNKNOWN = "__unknown__"


def place_name(c: Column) -> Column:
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), r"(?U)[^\w\s]", ""), r"\s+", " "))
    return F.when(c.isNull() | (F.trim(c) == ""), UNKNOWN).otherwise(text)


def classify_places(state_a: Column, area_a: Column, state_b: Column, area_b: Column) -> Column:
    sa, ca, sb, cb = (place_name(c) for c in (state_a, area_a, state_b, area_b))
    return (
        F.when((ca == UNKNOWN) | (cb == UNKNOWN), "UNKNOWN")
        .when((ca == cb) & (sa == sb), "SAME_CONSTITUENCY")
        .when(sa == sb, "SAME_STATE_DIFF_CONST")
        .when((sa == UNKNOWN) | (sb == UNKNOWN), "UNKNOWN")
        .otherwise("DIFF_STATE")
    )


def geo_weight(relationship: Column) -> Column:
    return lookup(relationship, GEO_WEIGHT, F.lit(0.5))


def geo_label(relationship: Column) -> Column:
    return lookup(relationship, GEO_LABEL, F.lit("LOW_GEO"))


def annotate_pairs(pairs: DataFrame) -> DataFrame:
    """Relationship, label and weight of each pair; coordinates are not used for scoring."""
    columns = (F.col(c) for c in ("state_a", "constituency_a", "state_b", "constituency_b"))
    known = pairs.withColumn("geo_relationship", classify_places(*columns))
    relation = F.col("geo_relationship")
    return known.withColumns(
        {
            "geo_risk_label": geo_label(relation),
            "geo_risk_weight": geo_weight(relation),
            "distance_m": F.lit(None).cast("double"),
            "location_proximity": F.lit("GPS_NOT_USED"),
            "location_source": F.lit("administrative_area"),
        }
    )


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    half = lambda x, y: F.sin(F.radians(y - x) / 2)
    a = half(lat_a, lat_b) * half(lat_a, lat_b) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half(
        lon_a, lon_b
    ) * half(lon_a, lon_b)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def in_range(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def distance_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Metres with two decimals; null when a coordinate is missing or out of range."""
    valid = in_range(lat_a, lon_a) & in_range(lat_b, lon_b)
    return F.when(valid, rounded(haversine_km(lat_a, lon_a, lat_b, lon_b) * 1000, 2))


def distance_band(metres: Column) -> Column:
    return (
        F.when(metres.isNull(), "GPS_UNAVAILABLE").when(metres <= 100, "SAME_SITE").when(metres <= 1000, "NEARBY").otherwise("SEPARATE")
    )


def location_sanity(lat: Column, lon: Column, state: Column) -> Column:
    """Inside the claimed state's box or not, worded as a plausibility signal."""
    inside = any_of(
        [
            (F.lower(F.trim(state)) == name) & lat.between(b[0], b[1]) & lon.between(b[2], b[3])
            for name, b in STATE_BOXES.items()
        ]
    )
    known = F.coalesce(F.lower(F.trim(state)).isin(list(STATE_BOXES)), F.lit(False))
    return (
        F.when(lat.isNull() | lon.isNull(), "NO_LOCATION")
        .when(~known, "NO_REFERENCE")
        .when(inside, "PLAUSIBLE")
        .otherwise("FAR_FROM_CLAIMED_STATE")
    )


def verified_coordinates(locations: DataFrame) -> DataFrame:
    """Valid, real or verified, not synthetic; one row per project."""
    said = lambda c, words: F.lower(F.col(c).cast("string")).isin(words)
    yes = ["true", "1", "yes"]
    has = lambda names: [n for n in names if n in locations.columns]
    synthetic = any_of([F.lit(False)] + [F.coalesce(said(c, yes), F.lit(False)) for c in has(["location_is_synthetic", "is_synthetic", "demo_only"])])
    real = F.lit(False)
    if has(["location_source"]):
        real = real | F.coalesce(said("location_source", ["real", "official_source", "geocoded_verified"]), F.lit(False))
    if has(["is_verified"]):
        real = real | F.coalesce(said("is_verified", yes), F.lit(False))
    kept = locations.filter(in_range(F.col("latitude"), F.col("longitude")) & real & ~synthetic)
    return keep_first(kept, ["project_id"], [])


def location_coverage(projects: DataFrame) -> DataFrame:
    """Every project with explicit markers that its source has no coordinates."""
    place = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")).alias(c)
    return projects.select(
        "project_id", place("state"), place("constituency"), F.lit("").alias("location_text"),
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
        F.lit("not_available").alias("location_source"), F.lit("not_available").alias("location_method"),
        F.lit(0.0).alias("confidence"), F.lit(False).alias("is_verified"),
    )


# --- neighbours -----------------------------------------------------------------------------------

RADIUS_KM = 5.0


def _sites(points: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each place (of an area, if ``keys`` name one): its points, their smallest and second smallest id."""
    # of many points at one place only the two smallest ids matter: two rounds of minima instead of a list of all
    sites = points.groupBy(*keys, "latitude", "longitude").agg(F.count("*").alias("n"), F.min("project_id").alias("low"))
    rest = points.join(sites.where("n > 1").select(*keys, "latitude", "longitude", "low"), [*keys, "latitude", "longitude"])
    second = rest.where(F.col("project_id") != F.col("low")).groupBy(*keys, "latitude", "longitude").agg(F.min("project_id").alias("second"))
    return sites.join(second, [*keys, "latitude", "longitude"], "left")


def _nearest(points: DataFrame, groups: list[list[str]], radii: tuple[float, ...]) -> list[DataFrame]:
    """For each list of keys, every point's nearest other among the points with equal keys: __id, __near_km, __near_id, __counts.

    All lists are searched in one hierarchy of cells, in which each value of the keys is an area of its own. Points at one place are one
    site; rows with a null key have no peers and are left out.
    """
    points = materialize(points, "points")
    parts, made = [], []
    for k, keys in enumerate(groups):
        own = points.dropna(subset=keys) if keys else points
        own = own.select(*keys, "project_id", "latitude", "longitude")
        sites = materialize(_sites(own, keys).withColumn("site", F.monotonically_increasing_id() * len(groups) + k), "sites")
        if keys:
            areas = materialize(sites.select(*keys).distinct().withColumn("area", (F.monotonically_increasing_id() + 1) * len(groups) + k), "areas")
            sites_in = sites.join(areas, keys)
        else:
            sites_in = sites.withColumn("area", F.lit(k).cast("long"))
        made.append(sites_in.select("site", "area", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "n", "low"))
        parts.append((own.withColumnRenamed("project_id", "__id"), sites, keys))
    found = materialize(nearest_sites(materialize(reduce(DataFrame.unionByName, made), "all-sites"), radii), "nearest")
    out = []
    for own, sites, keys in parts:
        told = sites.join(found.select("site", "km", F.col("low").alias("other"), "counts"), "site")
        met = own.join(told, [*keys, "latitude", "longitude"])
        shared = F.col("n") > 1
        near = F.when(shared, F.when(F.col("__id") == F.col("low"), F.col("second")).otherwise(F.col("low"))).otherwise(F.col("other"))
        out.append(met.select("__id", F.when(shared, 0.0).otherwise(F.col("km")).alias("__near_km"), near.alias("__near_id"), F.col("counts").alias("__counts")))
    return out


def nearest_site(points: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest other point of every point with the same ``keys``: __id, __near_km, __near_id; the smaller id of equally near ones.

    Points without another have no row.
    """
    return _nearest(points, [keys], ())[0].drop("__counts").filter("__near_km is not null")


def proximity_features(projects: DataFrame, locations: DataFrame) -> DataFrame:
    """Nearest project, counts within 0.5, 1 and 5 km, density and same-constituency neighbours per project.

    ``locations``: project_id, latitude, longitude, state, constituency; projects without coordinates get nulls.
    """
    points = locations.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    area = ["state", "constituency"]
    points = materialize(points.select("project_id", "latitude", "longitude", *area), "points")
    near, near_same = _nearest(points, [[], area], (0.5, 1.0, RADIUS_KM))
    near_same = near_same.select("__id", F.col("__near_km").alias("nearest_same_constituency_distance_km"))
    same = points.groupBy(*area).agg((F.count("*") - 1).alias("same_constituency_project_count"))
    within = lambda k: F.get("__counts", F.lit(k)) - 1
    counts = {"nearby_projects_500m": within(0), "nearby_projects_1km": within(1), "nearby_projects_5km": within(2)}
    located = (
        points.withColumn("__id", F.col("project_id")).join(near.withColumns(counts), "__id", "left").join(near_same, "__id", "left").join(same, area, "left")
    )
    features = located.select(
        "project_id", "latitude", "longitude", F.col("__near_id").alias("nearest_project_id"),
        F.col("__near_km").alias("nearest_project_distance_km"), "nearby_projects_500m", "nearby_projects_1km",
        "nearby_projects_5km", "same_constituency_project_count",
        (F.col("nearby_projects_5km") / (math.pi * RADIUS_KM**2)).alias("local_project_density"),
        "nearest_same_constituency_distance_km", F.lit(True).alias("location_data_available"),
    )
    out = projects.select("project_id").join(features, "project_id", "left")
    return out.withColumn("location_data_available", F.coalesce("location_data_available", F.lit(False)))


def location_similarity(descriptions: DataFrame, locations: DataFrame) -> DataFrame:
    """Description score blended with closeness to the nearest project (exp(-km/5), 60/40); alone where there is no location."""
    points = locations.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    near = nearest_site(points, []).withColumnRenamed("__id", "project_id")
    score = clip_or_null(F.col("description_similarity_score"), 0, 1)
    close = F.exp(-F.col("__near_km") / 5)
    has = F.col("__near_km").isNotNull()
    return descriptions.select("project_id", score.alias("description_similarity_score")).join(near, "project_id", "left").select(
        "project_id", F.col("__near_id").alias("similar_project_id"), "description_similarity_score",
        F.col("__near_km").alias("distance_km"), close.alias("location_proximity_score"),
        clip_or_null(
            F.when(has, 0.6 * F.col("description_similarity_score") + 0.4 * close).otherwise(F.col("description_similarity_score")), 0, 1
        ).alias("combined_similarity_score"),
        F.when(has, "description_plus_location").otherwise("description_only").alias("similarity_method"),
        has.alias("location_data_available"),
    )


def nearest_pairs(locations: DataFrame) -> DataFrame:
    """Each located project with its nearest other, closeness and a distance-based similarity."""
    points = locations.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    near = nearest_site(points, []).withColumnRenamed("__id", "project_id")
    km = F.col("__near_km")
    text = 0.65 + (1 - F.least(km / 10, F.lit(1.0))) * 0.3
    close = F.exp(-km / 5)
    return near.select(
        "project_id", F.col("__near_id").alias("similar_project_id"), rounded(text, 6).alias("description_similarity_score"),
        km.alias("distance_km"), close.alias("location_proximity_score"), rounded(0.6 * text + 0.4 * close, 6).alias("combined_similarity_score"),
    )


def location_report(projects: DataFrame, coverage: DataFrame, demo: DataFrame, features: DataFrame, similarity: DataFrame) -> DataFrame:
    """22 (metric, value) rows on coverage, validity, repeated coordinates and proximity."""
    one = lambda df, **aggs: df.agg(*[c.alias(n) for n, c in aggs.items()]).withColumn("__one", F.lit(1))
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    bad_lat, bad_lon = ~F.col("latitude").between(-90, 90), ~F.col("longitude").between(-180, 180)
    count = F.count_if
    zero = lambda c: F.coalesce(c, F.lit(0))
    ids = coverage.groupBy("project_id").agg(F.count("*").alias("__c"))
    spots = (
        coverage.select("latitude", "longitude").unionByName(demo.select("latitude", "longitude"))
        .filter(located).groupBy("latitude", "longitude").agg(F.count("*").alias("__c"))
    )
    synthetic = demo.select("project_id", F.lit(True).alias("__demo")).distinct()
    pairs = similarity.join(synthetic, "project_id", "left")
    km = F.col("distance_km")
    frames = [
        one(projects, total_projects=F.count("*")),
        one(coverage, real_coordinates=count(located), not_available_coordinates=count(F.col("location_source") == "not_available"),
            lat_a=count(bad_lat), lon_a=count(bad_lon)),
        one(demo, synthetic_coordinates=count(located), lat_b=count(bad_lat), lon_b=count(bad_lon)),
        one(ids, duplicate_project_ids=zero(F.sum(F.col("__c") - 1))),
        one(spots, duplicate_coordinates=zero(F.sum(F.col("__c") - 1))),
        one(features, projects_with_location_features=count(F.col("location_data_available")),
            projects_without_location_features=count(~F.col("location_data_available"))),
        one(pairs, self_similarity_pairs=count(F.col("project_id") == F.col("similar_project_id")),
            proximity_relationships=count(km.isNotNull()), projects_within_500m=count(km <= 0.5), projects_within_1km=count(km <= 1),
            projects_within_5km=count(km <= 5), missing_location_similarity_pairs=count(km.isNull()),
            description_plus_location_pairs=count(F.col("similarity_method") == "description_plus_location"),
            description_only_pairs=count(F.col("similarity_method") == "description_only"),
            synthetic_similarity_pairs=count(F.col("__demo"))),
    ]
    row = reduce(lambda a, b: a.join(b, "__one"), frames)
    total, placed = F.col("total_projects"), F.col("real_coordinates") + F.col("synthetic_coordinates")
    value = {
        "total_projects": total,
        "projects_with_coordinates": placed,
        "projects_without_coordinates": total - placed,
        "coordinate_coverage_pct": rounded(placed / total * 100, 4),
        "invalid_latitude": F.col("lat_a") + F.col("lat_b"),
        "invalid_longitude": F.col("lon_a") + F.col("lon_b"),
    }
    plain = [
        "real_coordinates", "synthetic_coordinates", "not_available_coordinates", "duplicate_project_ids", "duplicate_coordinates",
        "self_similarity_pairs", "proximity_relationships", "projects_within_500m", "projects_within_1km", "projects_within_5km",
        "projects_with_location_features", "projects_without_location_features", "missing_location_similarity_pairs",
        "description_plus_location_pairs", "description_only_pairs", "synthetic_similarity_pairs",
    ]
    value |= {name: F.col(name) for name in plain}
    return melt(row, {k: v.cast("double") for k, v in value.items()}, "metric", "value")
