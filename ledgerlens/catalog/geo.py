"""Administrative and geographic proximity over the coordinate view."""

from pyspark.sql import functions as F

from ledgerlens.catalog.registry import R, cte, query
from ledgerlens.functions.numbers import rounded
from ledgerlens.operators import geo

PLACE = "CASE WHEN coalesce(trim({0}),'')='' THEN '__unknown__' ELSE trim(regexp_replace(regexp_replace(trim(lower({0})),'[^\\w\\s]','','g'),'\\s+',' ','g')) END"
cte(
    "g_pairs",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_orderkey%7 WHEN 0 THEN NULL WHEN 1 THEN ' Nation-'||(l_suppkey%3) ELSE 'NATION '||(l_suppkey%3) END state_a, 'nation '||(l_partkey%3) state_b,
    CASE l_orderkey%11 WHEN 0 THEN ' ' ELSE 'Area '||(l_suppkey%4) END constituency_a, 'AREA  '||(l_partkey%4) constituency_b FROM lineitem""",
)
cte(
    "g_class",
    f"""SELECT *, CASE WHEN ca='__unknown__' OR cb='__unknown__' THEN 'UNKNOWN' WHEN ca=cb AND sa=sb THEN 'SAME_CONSTITUENCY' WHEN sa=sb THEN 'SAME_STATE_DIFF_CONST'
    WHEN sa='__unknown__' OR sb='__unknown__' THEN 'UNKNOWN' ELSE 'DIFF_STATE' END rel FROM (SELECT *, {PLACE.format("state_a")} sa, {PLACE.format("state_b")} sb, {PLACE.format("constituency_a")} ca, {PLACE.format("constituency_b")} cb FROM g_pairs)""",
)
LABELS = "CASE rel WHEN 'SAME_CONSTITUENCY' THEN 'CRITICAL_GEO' WHEN 'SAME_STATE_DIFF_CONST' THEN 'HIGH_GEO' WHEN 'DIFF_STATE' THEN 'MEDIUM_GEO' ELSE 'LOW_GEO' END"
WEIGHTS = "CASE rel WHEN 'SAME_CONSTITUENCY' THEN 1e0 WHEN 'SAME_STATE_DIFF_CONST' THEN 0.7e0 WHEN 'DIFF_STATE' THEN 0.4e0 ELSE 0.5e0 END"


def place_pairs(t):
    n = F.col("l_orderkey")
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(n % 7 == 1, F.concat(F.lit(" Nation-"), F.col("l_suppkey") % 3)).when(n % 7 > 1, F.concat(F.lit("NATION "), F.col("l_suppkey") % 3)).alias("state_a"),
        F.concat(F.lit("nation "), F.col("l_partkey") % 3).alias("state_b"),
        F.when(n % 11 == 0, " ").otherwise(F.concat(F.lit("Area "), F.col("l_suppkey") % 4)).alias("constituency_a"),
        F.concat(F.lit("AREA  "), F.col("l_partkey") % 4).alias("constituency_b"),
    )


@query("G01_classify_pair", "SELECT l_orderkey, l_linenumber, l_partkey, rel FROM g_class")
def g01(t):
    columns = [F.col(c) for c in ("state_a", "constituency_a", "state_b", "constituency_b")]
    return place_pairs(t).select("l_orderkey", "l_linenumber", "l_partkey", geo.classify_places(*columns).alias("rel"))


@query("G02_geo_weight", f"SELECT l_orderkey, l_linenumber, l_partkey, {LABELS} label, {WEIGHTS} weight FROM g_class")
def g02(t):
    rel = F.col("rel")
    return g01(t).select("l_orderkey", "l_linenumber", "l_partkey", geo.geo_label(rel).alias("label"), geo.geo_weight(rel).alias("weight"))


@query(
    "G03_annotate_pairs",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, rel geo_relationship, {LABELS} geo_risk_label, {WEIGHTS} geo_risk_weight, CAST(NULL AS DOUBLE) distance_m, 'GPS_NOT_USED' location_proximity,
    'administrative_area' location_source FROM g_class""",
)
def g03(t):
    return geo.annotate_pairs(place_pairs(t)).drop("state_a", "state_b", "constituency_a", "constituency_b")


def km(a, b, c, d):
    return f"2*6371e0*asin(least(1e0,sqrt(sin(radians({c}-{a})/2)*sin(radians({c}-{a})/2)+cos(radians({a}))*cos(radians({c}))*sin(radians({d}-{b})/2)*sin(radians({d}-{b})/2))))"


cte(
    "g_hop",
    """SELECT c_custkey, la, lo, lb, ob FROM (SELECT c_custkey, (c_custkey*37%18500)/100e0-92 la, (c_custkey*91%36000)/100e0-180 lo, (c_custkey*37%18500)/100e0-92+(c_custkey%50)/10000e0 lb,
    (c_custkey*91%36000)/100e0-180+(c_custkey%30)/5000e0 ob FROM customer)""",
)
OK = "abs(la)<=90 AND abs(lb)<=90 AND abs(lo)<=180 AND abs(ob)<=180"


def hops(t):
    n = F.col("c_custkey")
    la, lo = (n * 37 % 18500) / 100.0 - 92, (n * 91 % 36000) / 100.0 - 180
    return t.read("customer").select("c_custkey", la.alias("la"), lo.alias("lo"), (la + (n % 50) / 10000.0).alias("lb"), (lo + (n % 30) / 5000.0).alias("ob"))


HOP = ("la", "lo", "lb", "ob")


@query("G04_haversine", f"SELECT c_custkey, CASE WHEN {OK} THEN {R('1000*' + km('la', 'lo', 'lb', 'ob'), 2)} END metres FROM g_hop")
def g04(t):
    return hops(t).select("c_custkey", geo.distance_m(*[F.col(c) for c in HOP]).alias("metres"))


@query(
    "G05_distance_band",
    f"SELECT c_custkey, CASE WHEN m IS NULL THEN 'GPS_UNAVAILABLE' WHEN m<=100 THEN 'SAME_SITE' WHEN m<=1000 THEN 'NEARBY' ELSE 'SEPARATE' END band FROM (SELECT c_custkey, CASE WHEN {OK} THEN {R('1000*' + km('la', 'lo', 'lb', 'ob'), 2)} END m FROM g_hop)",
)
def g05(t):
    return hops(t).select("c_custkey", geo.distance_band(geo.distance_m(*[F.col(c) for c in HOP])).alias("band"))


cte("g_pts", "SELECT * FROM r_coords WHERE latitude IS NOT NULL")
cte(
    "g_all",
    f"""SELECT a.project_id, b.project_id other, {km("a.latitude", "a.longitude", "b.latitude", "b.longitude")} d, a.state=b.state AND a.constituency=b.constituency same FROM g_pts a JOIN g_pts b ON a.project_id<>b.project_id""",
)
cte("g_near", f"SELECT project_id, first(other ORDER BY d, other) other, min(d) d FROM g_all GROUP BY 1")


@query(
    "G06_proximity_features",
    f"""SELECT c.project_id, {R("nearest", 6)} nearest_project_distance_km, n5 nearby_projects_500m, n1 nearby_projects_1km, n50 nearby_projects_5km, sc same_constituency_project_count,
    {R("n50/(pi()*25)", 6)} local_project_density, {R("ns", 6)} nearest_same_constituency_distance_km, latitude IS NOT NULL location_data_available FROM r_coords c LEFT JOIN (SELECT project_id, min(d) nearest,
    count(*) FILTER (d<=0.5) n5, count(*) FILTER (d<=1) n1, count(*) FILTER (d<=5) n50, count(*) FILTER (same) sc, min(d) FILTER (same) ns FROM g_all GROUP BY 1) USING (project_id)""",
)
def g06(t):
    out = geo.proximity_features(t.coordinates, t.coordinates).drop("latitude", "longitude", "nearest_project_id")
    loose = ["nearest_project_distance_km", "local_project_density", "nearest_same_constituency_distance_km"]
    return out.withColumns({c: rounded(F.col(c), 6) for c in loose})


@query(
    "G07_location_similarity",
    f"""SELECT c.project_id, s description_similarity_score, {R("d", 6)} distance_km, {R("exp(-d/5)", 6)} location_proximity_score, {R("coalesce(0.6e0*s+0.4e0*exp(-d/5),s)", 6)} combined_similarity_score,
    CASE WHEN d IS NOT NULL THEN 'description_plus_location' ELSE 'description_only' END similarity_method FROM (SELECT project_id, (CAST(substr(project_id,2) AS BIGINT)%120)/100e0 s0, least(1e0,(CAST(substr(project_id,2) AS BIGINT)%120)/100e0) s FROM r_coords) c LEFT JOIN g_near USING (project_id)""",
)
def g07(t):
    scores = t.coordinates.select("project_id", (F.substring("project_id", 2, 20).cast("long") % 120 / 100.0).alias("description_similarity_score"))
    out = geo.location_similarity(scores, t.coordinates).drop("similar_project_id", "location_data_available")
    return out.withColumns({c: rounded(F.col(c), 6) for c in ("distance_km", "location_proximity_score", "combined_similarity_score")})


@query(
    "G08_nearest_pairs",
    f"""SELECT project_id, {R("d", 6)} distance_km, {R("0.65e0+(1-least(d/10,1e0))*0.3e0", 6)} description_similarity_score, {R("0.6e0*(0.65e0+(1-least(d/10,1e0))*0.3e0)+0.4e0*exp(-d/5)", 6)} combined_similarity_score FROM g_near""",
)
def g08(t):
    out = geo.nearest_pairs(t.coordinates)
    return out.select("project_id", rounded(F.col("distance_km"), 6).alias("distance_km"), "description_similarity_score", "combined_similarity_score")


@query(
    "G09_verified_coordinates",
    "SELECT project_id, latitude, longitude FROM r_coords WHERE latitude IS NOT NULL AND NOT location_is_synthetic AND (lower(location_source) IN ('real','official_source') OR is_verified)",
)
def g09(t):
    return geo.verified_coordinates(t.coordinates).select("project_id", "latitude", "longitude")


@query(
    "G10_location_coverage",
    """SELECT project_id, state, constituency, '' location_text, CAST(NULL AS DOUBLE) latitude, CAST(NULL AS DOUBLE) longitude, 'not_available' location_source, 'not_available' location_method,
    0e0 confidence, false is_verified FROM r_works""",
)
def g10(t):
    return geo.location_coverage(t.works)


BOXES = " OR ".join(f"(st='{s}' AND la BETWEEN {b[0]} AND {b[1]} AND lo BETWEEN {b[2]} AND {b[3]})" for s, b in geo.STATE_BOXES.items())
NAMES = list(geo.STATE_BOXES) + ["atlantis"]


@query(
    "G11_location_sanity",
    f"""SELECT c_custkey, CASE WHEN la IS NULL THEN 'NO_LOCATION' WHEN st='atlantis' THEN 'NO_REFERENCE' WHEN {BOXES} THEN 'PLAUSIBLE' ELSE 'FAR_FROM_CLAIMED_STATE' END sanity FROM (SELECT c_custkey,
    ({NAMES!r})[c_custkey%21+1] st, CASE WHEN c_custkey%10<>0 THEN 8+(c_custkey*37%2500)/100e0 END la, 68+(c_custkey*91%2600)/100e0 lo FROM customer)""",
)
def g11(t):
    n = F.col("c_custkey")
    state = F.element_at(F.array(*[F.lit(x.title()) for x in NAMES]), (n % 21 + 1).cast("int"))
    lat, lon = F.when(n % 10 != 0, 8 + (n * 37 % 2500) / 100.0), 68 + (n * 91 % 2600) / 100.0
    return t.read("customer").select("c_custkey", geo.location_sanity(lat, lon, state).alias("sanity"))


@query(
    "V14_location_report",
    """SELECT m metric, CAST(v AS DOUBLE) AS value FROM (SELECT unnest([""" + ",".join(
        f"struct_pack(m:='{m}',v:=CAST({v} AS DOUBLE))"
        for m, v in {
            "total_projects": "n", "projects_with_coordinates": "loc", "projects_without_coordinates": "n-loc",
            "coordinate_coverage_pct": R("loc/CAST(n AS DOUBLE)*100", 4), "real_coordinates": "0", "synthetic_coordinates": "loc",
            "not_available_coordinates": "n", "duplicate_project_ids": "0", "invalid_latitude": "0", "invalid_longitude": "0",
            "duplicate_coordinates": "loc-spots", "self_similarity_pairs": "0", "proximity_relationships": "loc", "projects_within_500m": "w5",
            "projects_within_1km": "w1", "projects_within_5km": "w50", "projects_with_location_features": "loc",
            "projects_without_location_features": "n-loc", "missing_location_similarity_pairs": "n-loc",
            "description_plus_location_pairs": "loc", "description_only_pairs": "n-loc", "synthetic_similarity_pairs": "n",
        }.items()
    )
    + """],recursive:=true) FROM (SELECT (SELECT count(*) FROM r_coords) n, (SELECT count(*) FROM g_pts) loc, (SELECT count(DISTINCT (latitude,longitude)) FROM g_pts) spots,
    (SELECT count(*) FROM g_near WHERE d<=0.5) w5, (SELECT count(*) FROM g_near WHERE d<=1) w1, (SELECT count(*) FROM g_near WHERE d<=5) w50))""",
)
def v14(t):
    places = t.coordinates
    scores = places.select("project_id", F.lit(0.5).alias("description_similarity_score"))
    similar = geo.location_similarity(scores, places)
    features = places.select("project_id", F.col("latitude").isNotNull().alias("location_data_available"))
    return geo.location_report(places, geo.location_coverage(places), places, features, similar)
