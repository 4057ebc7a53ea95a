"""Every registered query against its SQL; the others for rows and repeatability."""

import pytest

import __spark_entry__ as entry
import compare
from wardline.plans import catalog
from conftest import SF

NAMES = sorted(catalog.QUERIES)
# Queries that walk through a key's rows in order.
ORDERED = [
    "behaviour_funnel", "behaviour_sequence", "beaconing", "build_bundle", "context_asof", "correlate_pairs",
    "custom_aggregate", "dedup_alerts", "elapsed_parts", "explain_anomaly", "flagship", "frequency_rule", "mad_anomalies",
    "multiview_score", "posture_summary", "publish_cti_events", "risk_rank", "root_cause", "sessionize_alerts",
    "summarize_lines", "timeline", "transition_matrix",
]


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    if name in entry.oracle_sql():
        assert compare.difference(df, con, entry.oracle_sql()[name]) is None
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ORDERED)
def test_query_with_heavy_keys(heavy, con, name):
    df = entry.queries()[name](heavy, SF)
    assert compare.difference(df, con, entry.oracle_sql()[name]) is None


def test_only_models_go_without_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"kmeans_anomalies"}


def test_entry(spark):
    first = entry.entry(spark)
    assert first.count() > 0
    assert first.schema == entry.entry(spark).schema
