"""Hand-made rows, one case per semantic trap of the statements."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionflow.operators import commerce, funnel, overview, quality
from sessionflow.schema import Period
from tests.events import HOUR, ev, frame

V, C, K, P = "view_item", "add_to_cart", "begin_checkout", "purchase"


def _counts(df):
    return [r.sessions for r in df.orderBy("step_number").collect()]


def test_first_non_null_device_and_two_unknown_rows(spark):
    rows = [
        ev(V, 1, "a", 1, device=None),
        ev(V, 2, "a", 1, device="mobile"),
        ev(V, 1, "b", 1, device=None),
        ev(V, 5, "b", 1, device=None),
        ev(V, 1, "c", 1, device="unknown"),
    ]
    out = funnel.funnel_by_device(frame(spark, rows), None).collect()
    got = sorted((r.device_category, r.view_item_sessions) for r in out)
    assert got == [("mobile", 1), ("unknown", 1), ("unknown", 1)]


def test_presence_keeps_null_user_ordered_drops_it(spark):
    rows = [ev(s, i + 1, None, 1) for i, s in enumerate([V, C, K, P])]
    df = frame(spark, rows)
    assert _counts(funnel.presence_funnel(df, None)) == [1, 1, 1, 1]
    assert _counts(funnel.ordered_funnel(df, None)) == [0, 0, 0, 0]


def test_null_session_order_has_no_context(spark):
    rows = [
        ev(P, 1, "a", None, txn="T1", revenue=10.0),
        ev(P, 2, "a", None, txn="T1", revenue=10.0),
    ]
    df = frame(spark, rows)
    q = commerce.purchase_quality(df, None).first()
    assert (q.unique_orders, q.unique_transaction_ids, q.reused_transaction_ids) == (1, 1, 0)
    assert commerce.kpi_overview(df, None).first().orders == 1


def test_order_on_two_days_counts_once_overall_twice_daily(spark):
    rows = [
        ev(P, 1, "a", 1, day="20240110", txn="T1", revenue=20.0),
        ev(P, 2, "a", 1, day="20240111", txn="T1", revenue=20.0),
    ]
    df = frame(spark, rows)
    assert commerce.kpi_overview(df, None).first().orders == 1
    daily = commerce.kpi_daily(df, None).collect()
    assert [r.orders for r in daily] == [1, 1]


def test_journey_tie_goes_to_smallest_key_and_skips_null_user(spark):
    day = "20240110"
    rows = [
        # busiest purchase session has a null user: never chosen
        *[ev(V, i, None, 9, day=day) for i in range(5)],
        ev(P, 9, None, 9, day=day),
        # two sessions of equal size: "b" < "c"
        ev(V, 1, "c", 1, day=day),
        ev(P, 2, "c", 1, day=day, revenue=5.0),
        ev(V, 3, "b", 1, day=day),
        ev(P, 4, "b", 1, day=day, revenue=7.0),
    ]
    out = overview.purchase_session_journey(frame(spark, rows), day).collect()
    assert {r.event_name: r.purchase_revenue for r in out} == {V: None, P: 7.0}


def test_sample_records_stable_under_ties(spark):
    rows = [ev(V, 5, u, 1) for u in ("c", "a", "b")]
    df = frame(spark, rows)
    first = [r.user_pseudo_id for r in overview.sample_records(df, "20240110", 2).collect()]
    again = [r.user_pseudo_id for r in overview.sample_records(df, "20240110", 2).collect()]
    assert first == again == ["a", "b"]


def test_source_and_medium_come_from_one_row(spark):
    rows = [
        ev(V, 1, "a", 1, source="b", medium="w"),
        ev(V, 1, "a", 1, source="a", medium="x"),
    ]
    out = funnel.funnel_by_first_source(frame(spark, rows), None, min_sessions=0).collect()
    assert [(r.first_user_source, r.first_user_medium) for r in out] == [("a", "x")]


def test_null_source_and_medium_get_fallback_labels(spark):
    rows = [ev(V, 1, "a", 1, source=None, medium=None)]
    out = funnel.funnel_by_first_source(frame(spark, rows), None, min_sessions=0).first()
    assert (out.first_user_source, out.first_user_medium) == ("(direct)", "(none)")


def test_strict_order_and_greedy_chain(spark):
    rows = [
        # session 1: cart before view only -> stage 1
        ev(C, 1, "s1", 1),
        ev(V, 2, "s1", 1),
        # session 2: view, cart, view, cart, checkout -> stage 3
        ev(V, 1, "s2", 1),
        ev(C, 2, "s2", 1),
        ev(V, 3, "s2", 1),
        ev(C, 4, "s2", 1),
        ev(K, 5, "s2", 1),
        # session 3: all four at one time -> stage 1
        *[ev(n, 7, "s3", 1) for n in (V, C, K, P)],
    ]
    df = frame(spark, rows)
    assert _counts(funnel.ordered_funnel(df, None)) == [3, 1, 1, 0]
    times = funnel.ordered_stage_times(df, None).orderBy("user_pseudo_id").collect()
    assert [(r._t0, r._t1, r._t2, r._t3) for r in times] == [
        (2, None, None, None),
        (1, 2, 5, None),
        (7, None, None, None),
    ]


def test_zero_day_with_other_events_only(spark):
    rows = [
        ev(V, 1, "a", 1, day="20240101"),
        ev(C, 2, "a", 1, day="20240101"),
        ev("page_view", 3, "a", 1, day="20240102"),
        ev(V, 4, "a", 1, day="20240103"),
        ev(V, 5, "a", 1, day="20240103"),
        ev(C, 6, "a", 1, day="20240103"),
    ]
    r = quality.reliable_period(frame(spark, rows), None).first()
    assert r.last_zero_add_to_cart_date == dt.date(2024, 1, 2)
    assert r.candidate_reliable_start_date == dt.date(2024, 1, 3)
    assert r.days_with_zero_add_to_cart == 1
    # the zero day has 0 / 0: no ratio, so min / max come from the other days
    assert (r.minimum_daily_cart_to_view_pct, r.maximum_daily_cart_to_view_pct) == (50.0, 100.0)


def test_no_purchases_and_empty_input(spark):
    df = frame(spark, [ev(V, 1, "a", 1)])
    k = commerce.kpi_overview(df, None).first()
    assert (k.orders, k.revenue, k.average_order_value) == (0, None, None)
    d = commerce.kpi_daily(df, None).first()
    assert (d.orders, d.revenue, d.average_order_value) == (0, 0.0, None)
    empty = frame(spark, [])
    rows = funnel.ordered_funnel(empty, None).orderBy("step_number").collect()
    assert [r.sessions for r in rows] == [0, 0, 0, 0]
    assert rows[0].conversion_from_previous_step_pct == 100.0
    assert [r.conversion_from_view_item_pct for r in rows[1:]] == [None, None, None]


def test_order_revenue_is_max_and_null_revenue_orders_count(spark):
    rows = [
        ev(P, 1, "a", 1, txn="T1", revenue=10.0),
        ev(P, 2, "a", 1, txn="T1", revenue=30.0),
        ev(P, 3, "b", 1, txn="T2", revenue=None),
    ]
    k = commerce.kpi_overview(frame(spark, rows), None).first()
    assert (k.orders, k.revenue, k.average_order_value) == (2, 30.0, 15.0)


def test_repeated_param_takes_first_and_all_null_revenue_is_null_array(spark):
    rows = [
        ev(P, 1, "a", params=[("ga_session_id", 5), ("ga_session_id", 6)], txn="T1"),
        ev(P, 2, "a", 1, txn="T1"),
    ]
    df = frame(spark, rows)
    r = overview.sample_records(df, "20240110", 1).first()
    assert r.ga_session_id == 5
    a = commerce.revenue_anomalies(df, None).first()
    assert a.transaction_id == "T1" and a.recorded_revenue_values is None


def test_not_set_transaction_is_missing(spark):
    rows = [ev(P, 1, "a", 1, txn="(not set)", revenue=5.0), ev(P, 2, "a", 1, txn="T", revenue=5.0)]
    q = commerce.purchase_quality(frame(spark, rows), None).first()
    assert (q.purchase_events, q.events_missing_transaction_id, q.unique_orders) == (2, 1, 1)


def test_percent_columns_are_double(spark):
    df = frame(spark, [ev(V, 1)])
    for out in (
        funnel.ordered_funnel(df, None),
        funnel.presence_funnel(df, None),
        funnel.funnel_dropoff(df, None),
        funnel.funnel_by_device(df, None),
    ):
        for f in out.schema.fields:
            if f.name.endswith("_pct"):
                assert isinstance(f.dataType, T.DoubleType), (f.name, f.dataType)


def test_sessions_need_both_keys_and_do_not_collide(spark):
    rows = [ev(V, 1, "a", 1), ev(V, 2, "a-1", 1), ev(V, 3, "a", None), ev(V, 4, None, 1)]
    r = overview.dataset_overview(frame(spark, rows)).first()
    assert (r.total_events, r.total_users, r.total_sessions) == (4, 2, 2)


def test_period_filters_by_suffix(spark):
    rows = [ev(V, 1, "a", 1, day="20240101"), ev(V, 2, "b", 1, day="20240105")]
    out = funnel.ordered_funnel(frame(spark, rows), Period("20240102", "20240131"))
    assert _counts(out)[0] == 1


def test_custom_stages_and_labels(spark):
    rows = [ev(V, 1, "a", 1), ev(P, 2, "a", 1), ev(V, 1, "b", 1)]
    out = funnel.ordered_funnel(frame(spark, rows), None, [V, P], ["Saw", "Bought"]).collect()
    assert [(r.funnel_step, r.sessions, r.conversion_from_view_item_pct) for r in out] == [
        ("Saw", 2, 100.0),
        ("Bought", 1, 50.0),
    ]


def test_hour_scale_times(spark):
    rows = [ev(V, HOUR, "a", 1), ev(C, 2 * HOUR, "a", 1)]
    assert _counts(funnel.ordered_funnel(frame(spark, rows), None)) == [1, 1, 0, 0]


def test_repeated_key_check_and_official_period(spark):
    rows = [
        ev(P, 1, "a", params=[("ga_session_id", 5), ("ga_session_id", 6)]),
        ev(C, 2, "a", 1),
        ev(V, 3, "a", 1, day="20240101"),
        ev("page_view", 4, "a", 1, day="20240102"),
        ev(C, 5, "a", 1, day="20240103"),
    ]
    df = frame(spark, rows)
    r = quality.repeated_param_keys(df, None).first()
    assert (r.total_events, r.events_with_repeated_key) == (5, 1)
    # 2024-01-01 and 2024-01-02 have no add_to_cart: the period starts on the 3rd
    got = quality.official_period(df, Period("20240101", "20240110"))
    assert (got.start, got.end) == ("20240103", "20240110")
    # the last day lacks add_to_cart: no reliable day is left
    assert quality.official_period(df, Period("20240101", "20240102")) is None
    # no zero day: the review period itself
    got = quality.official_period(df, Period("20240103", "20240110"))
    assert (got.start, got.end) == ("20240103", "20240110")


def test_segment_funnel_by_country(spark):
    rows = [ev(V, 1, "a", 1, country="X"), ev(C, 2, "a", 1), ev(V, 1, "b", 1, country=None)]
    out = funnel.funnel_by_segment(
        frame(spark, rows), None, F.col("geo.country"), name="country", null_label="(unknown)"
    ).collect()
    assert sorted((r.country, r.view_item_sessions, r.add_to_cart_sessions) for r in out) == [
        ("(unknown)", 1, 0),
        ("X", 1, 1),
    ]


def test_journey_without_any_purchase_session_is_empty(spark):
    rows = [ev(V, 1, "a", 1), ev(C, 2, "a", 1), ev(P, 3, None, 2)]
    out = overview.purchase_session_journey(frame(spark, rows), "20240110")
    assert out.count() == 0
    assert out.columns == [
        "event_name", "event_count", "first_event_time", "last_event_time", "purchase_revenue"
    ]
