"""Relations between statements (the reference's published tables obey them)."""

from __future__ import annotations

import pytest

from sessionflow.operators import commerce, funnel
from sessionflow.sources.fixture import FIXTURE_OFFICIAL, DerivedEventSource
from tests.conftest import SF_MID

OFF = FIXTURE_OFFICIAL


@pytest.fixture(scope="module")
def src(spark):
    return DerivedEventSource(spark, SF_MID)


def _steps(df):
    return [r.sessions for r in df.orderBy("step_number").collect()]


def test_ordered_within_presence_and_non_increasing(src):
    ordered = _steps(funnel.ordered_funnel(src, OFF))
    presence = _steps(funnel.presence_funnel(src, OFF))
    assert all(o <= p for o, p in zip(ordered, presence))
    assert ordered == sorted(ordered, reverse=True)
    assert presence == sorted(presence, reverse=True)


def test_devices_sum_to_total(src):
    total = _steps(funnel.ordered_funnel(src, OFF))
    rows = funnel.funnel_by_device(src, OFF).collect()
    cols = ["view_item_sessions", "add_to_cart_sessions", "begin_checkout_sessions", "purchase_sessions"]
    assert [sum(r[c] for r in rows) for c in cols] == total


def test_sources_sum_to_total_without_threshold(src):
    total = _steps(funnel.ordered_funnel(src, OFF))
    rows = funnel.funnel_by_first_source(src, OFF, min_sessions=0, top=None).collect()
    assert sum(r.view_item_sessions for r in rows) == total[0]
    assert sum(r.purchase_sessions for r in rows) == total[3]


def test_dropoff_is_difference_of_ordered_steps(src):
    steps = _steps(funnel.ordered_funnel(src, OFF))
    rows = funnel.funnel_dropoff(src, OFF).orderBy("transition_number").collect()
    for k, r in enumerate(rows):
        assert (r.starting_sessions, r.continuing_sessions) == (steps[k], steps[k + 1])
        assert r.dropped_sessions == steps[k] - steps[k + 1]
        assert r.dropoff_rate_pct == round(100 * (steps[k] - steps[k + 1]) / steps[k], 2)


def test_presence_vs_ordered(src):
    rows = funnel.presence_vs_ordered(src, OFF).orderBy("step_number").collect()
    assert [r.ordered_sessions for r in rows] == _steps(funnel.ordered_funnel(src, OFF))
    assert [r.presence_sessions for r in rows] == _steps(funnel.presence_funnel(src, OFF))
    assert all(r.sessions_excluded_by_ordering == r.presence_sessions - r.ordered_sessions for r in rows)


def test_order_counts_agree(src):
    overall = commerce.kpi_overview(src, OFF).first()
    quality = commerce.purchase_quality(src, OFF).first()
    daily = commerce.kpi_daily(src, OFF).collect()
    assert quality.unique_orders == overall.orders
    assert sum(r.orders for r in daily) >= overall.orders
    assert sum(r.revenue for r in daily) >= overall.revenue


def test_anomalous_events_cover_anomalies(src):
    anomalies = commerce.revenue_anomalies(src, OFF).collect()
    events = commerce.anomalous_purchase_events(src, OFF).collect()
    assert {r.transaction_id for r in events} == {r.transaction_id for r in anomalies}
    assert len(events) == sum(r.purchase_events for r in anomalies)


def test_fixture_expected_values(src):
    """Values stated for the test view at sf0.01 (computed independently)."""
    assert _steps(funnel.ordered_funnel(src, OFF)) == [835, 410, 153, 42]
    assert _steps(funnel.presence_funnel(src, OFF)) == [843, 601, 426, 303]
    k = commerce.kpi_overview(src, OFF).first()
    assert (k.users, k.sessions, k.orders, k.revenue) == (150, 1181, 939, 38340.0)
