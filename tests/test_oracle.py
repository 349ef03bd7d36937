"""Registered queries against their check SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# one or two per area; tools/check.py compares all of them
NAMES = [
    "C03_parse_amount", "C05_strict_date", "C17_format_inr", "C18_fingerprint", "S05_event_log", "V05_duplicate_key",
    "V11_expenditure_matching", "V13_feature_quality", "F08_project_features", "A02_vendor_features", "J12_resolve_expenditures",
    "W01_competition_rank", "W02_sequence_rank", "R15_significant_gap", "A07_project_rollup", "O02_top_cases", "Y08_payment_scores_given_isolation",
    "Z07_agency_reasons", "E07_alerts", "K02_rank_cases", "I14_risk_results", "A10_project_similarity_features", "T04_duplicate_pairs",
    "T14_hash_duplicates", "G06_proximity_features", "A14_state_risk", "P01_project_search", "N07_public_feed", "B03_report_states",
    "D09_cost_composite", "D14_delay_scores", "L06_project_state", "L01_derive_events",
]


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_registry_is_consistent():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 200


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    index = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in index) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 100
