"""Statements against direct Python on random rows (null keys, placeholders,
multi-day orders): presence funnel, overview, quality checks, KPIs, purchase
checks and the purchase-session journey."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest

from sessionflow.operators import commerce, funnel
from tests.events import ev, frame

NAMES = ["view_item", "add_to_cart", "begin_checkout", "purchase", "page_view"]
DAYS = ["20240110", "20240111", "20240112"]


def _random_rows(seed: int, n: int = 600):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        user = rnd.choice([None, "u1", "u2", "u3", "u4", "u5"])
        session = rnd.choice([None, 1, 2, 3])
        name = rnd.choice(NAMES)
        txn = rev = None
        if name == "purchase":
            txn = rnd.choice([None, "(not set)", "T1", "T2", "T3", f"T{i}"])
            rev = rnd.choice([None, 0.0, 10.0, 20.0, 35.5])
        out.append(
            dict(name=name, t=rnd.randint(0, 50), user=user, session=session,
                 day=rnd.choice(DAYS), txn=txn, rev=rev)
        )
    return out


def _frame(spark, rows):
    return frame(spark, [
        ev(r["name"], r["t"], r["user"], r["session"], day=r["day"], txn=r["txn"], revenue=r["rev"])
        for r in rows
    ])


def _txn(r):
    return None if r["txn"] == "(not set)" else r["txn"]


def _round(x):
    return None if x is None else round(x, 2)


@pytest.fixture(scope="module", params=[11, 12])
def data(request, spark):
    rows = _random_rows(request.param)
    return rows, _frame(spark, rows)


def test_presence_funnel(data):
    rows, df = data
    stages = list(funnel.CORE_STAGES)
    seen = defaultdict(set)
    for r in rows:
        if r["session"] is not None and r["name"] in stages:
            seen[(r["user"], r["session"])].add(r["name"])
    want = [sum(all(s in names for s in stages[: k + 1]) for names in seen.values()) for k in range(4)]
    got = [r.sessions for r in funnel.presence_funnel(df, None).orderBy("step_number").collect()]
    assert got == want


def _orders(rows, by_day=False):
    orders = {}
    for r in rows:
        if r["name"] == "purchase" and _txn(r) is not None:
            key = ((r["day"],) if by_day else ()) + (r["user"], r["session"], _txn(r))
            revs = orders.setdefault(key, [])
            if r["rev"] is not None:
                revs.append(r["rev"])
    return {k: (max(v) if v else None) for k, v in orders.items()}


def test_kpi_overview(data):
    rows, df = data
    users = {r["user"] for r in rows if r["user"] is not None}
    sessions = {(r["user"], r["session"]) for r in rows if r["user"] is not None and r["session"] is not None}
    orders = _orders(rows)
    revs = [v for v in orders.values() if v is not None]
    revenue = sum(revs) if revs else None
    k = commerce.kpi_overview(df, None).first()
    assert (k.users, k.sessions, k.orders) == (len(users), len(sessions), len(orders))
    assert k.revenue == _round(revenue)
    assert k.average_order_value == (_round(revenue / len(orders)) if orders and revenue is not None else None)
    assert k.analysis_start_date == dt.date(2024, 1, 10)


def test_kpi_daily(data):
    rows, df = data
    orders = _orders(rows, by_day=True)
    got = {r.event_date.strftime("%Y%m%d"): r for r in commerce.kpi_daily(df, None).collect()}
    assert set(got) == {r["day"] for r in rows}
    for day, r in got.items():
        day_rows = [x for x in rows if x["day"] == day]
        users = {x["user"] for x in day_rows if x["user"] is not None}
        sessions = {(x["user"], x["session"]) for x in day_rows if x["user"] is not None and x["session"] is not None}
        day_orders = {k: v for k, v in orders.items() if k[0] == day}
        revenue = sum(v for v in day_orders.values() if v is not None)
        assert (r.users, r.sessions, r.orders) == (len(users), len(sessions), len(day_orders))
        assert r.revenue == round(revenue, 2)


def test_purchase_quality_and_anomalies(data):
    rows, df = data
    purchases = [r for r in rows if r["name"] == "purchase"]
    groups = defaultdict(list)
    contexts = defaultdict(set)
    by_txn = defaultdict(list)
    for r in purchases:
        t = _txn(r)
        if t is None:
            continue
        groups[(r["user"], r["session"], t)].append(r["rev"])
        by_txn[t].append(r["rev"])
        if r["user"] is not None and r["session"] is not None:
            contexts[t].add((r["user"], r["session"]))
    q = commerce.purchase_quality(df, None).first()
    assert q.purchase_events == len(purchases)
    assert q.events_missing_transaction_id == sum(_txn(r) is None for r in purchases)
    assert q.events_missing_revenue == sum(r["rev"] is None for r in purchases)
    assert q.unique_orders == len(groups)
    assert q.unique_transaction_ids == len(by_txn)
    assert q.reused_transaction_ids == sum(len(c) > 1 for c in contexts.values())
    assert q.orders_with_duplicate_events == sum(len(v) > 1 for v in groups.values())
    assert q.extra_duplicate_purchase_events == (sum(len(v) - 1 for v in groups.values()) if groups else None)
    maxes = [max([x for x in v if x is not None], default=None) for v in groups.values()]
    assert q.orders_missing_revenue == sum(m is None for m in maxes)
    assert q.orders_with_non_positive_revenue == sum((m or 0) <= 0 for m in maxes)
    assert q.orders_with_conflicting_revenue == sum(
        len({x for x in v if x is not None}) > 1 for v in groups.values()
    )
    want = {
        t: sorted({x for x in v if x is not None})
        for t, v in by_txn.items()
        if all(x is None for x in v) or len({x for x in v if x is not None}) > 1
    }
    got = {r.transaction_id: (r.recorded_revenue_values or []) for r in commerce.revenue_anomalies(df, None).collect()}
    assert got == want
    events = commerce.anomalous_purchase_events(df, None).collect()
    assert len(events) == sum(len(by_txn[t]) for t in want)


def test_overview_and_quality_checks(data):
    from sessionflow.operators import overview, quality

    rows, df = data
    o = overview.dataset_overview(df).first()
    assert o.total_events == len(rows)
    assert o.total_users == len({r["user"] for r in rows if r["user"] is not None})
    assert o.total_sessions == len(
        {(r["user"], r["session"]) for r in rows if r["user"] is not None and r["session"] is not None}
    )
    core = [r for r in rows if r["name"] in funnel.CORE_STAGES]
    u = quality.missing_user_id(df, None).first()
    assert (u.total_core_events, u.events_missing_user_id) == (len(core), sum(r["user"] is None for r in core))
    s = quality.missing_session_id(df, None).first()
    assert s.events_missing_session_id == sum(r["session"] is None for r in core)
    daily = {r.event_date.strftime("%Y%m%d"): r for r in quality.daily_event_counts(df, None).collect()}
    for day, r in daily.items():
        names = [x["name"] for x in rows if x["day"] == day]
        assert (r.view_item_events, r.add_to_cart_events) == (names.count("view_item"), names.count("add_to_cart"))
    ratios = []
    zero_days = []
    for day in sorted({r["day"] for r in rows}):
        names = [x["name"] for x in rows if x["day"] == day]
        carts, views = names.count("add_to_cart"), names.count("view_item")
        if carts == 0:
            zero_days.append(day)
        if views:
            ratios.append(carts / views)
    rp = quality.reliable_period(df, None).first()
    assert rp.days_with_zero_add_to_cart == len(zero_days)
    assert rp.minimum_daily_cart_to_view_pct == (round(100 * min(ratios), 2) if ratios else None)


def test_purchase_session_journey(data):
    from sessionflow.operators import overview

    rows, df = data
    day = DAYS[0]
    day_rows = [r for r in rows if r["day"] == day and r["user"] is not None and r["session"] is not None]
    sizes = defaultdict(int)
    buyers = set()
    for r in day_rows:
        sizes[(r["user"], r["session"])] += 1
        if r["name"] == "purchase":
            buyers.add((r["user"], r["session"]))
    if not buyers:
        return
    best = min(buyers, key=lambda k: (-sizes[k], k[0], k[1]))
    chosen = [r for r in day_rows if (r["user"], r["session"]) == best and r["name"] in
              ("view_item", "add_to_cart", "begin_checkout", "purchase")]
    want = {}
    for r in chosen:
        n, lo, hi, rv = want.get(r["name"], (0, None, None, None))
        want[r["name"]] = (
            n + 1,
            r["t"] if lo is None else min(lo, r["t"]),
            r["t"] if hi is None else max(hi, r["t"]),
            rv if r["rev"] is None else (r["rev"] if rv is None else max(rv, r["rev"])),
        )
    epoch = dt.datetime(1970, 1, 1)
    got = {
        r.event_name: (
            r.event_count,
            int((r.first_event_time - epoch).total_seconds() * 1_000_000),
            int((r.last_event_time - epoch).total_seconds() * 1_000_000),
            r.purchase_revenue,
        )
        for r in overview.purchase_session_journey(df, day).collect()
    }
    assert got == want
