"""Products, attribution, customer scores and journeys against direct Python."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sessionflow.operators import attribution, commerce, customers, journeys, products
from sessionflow.plans.quantiles import bucket, bucket_ends, quantile_cuts
from sessionflow.schema import CORE_STAGES, NOT_SET, Period
from tests.events import HOUR, ev, frame

DAYS = ("20240110", "20240111", "20240112")
PERIOD = Period(DAYS[0], DAYS[-1])
START = dict(zip(DAYS, (1704844800000000, 1704931200000000, 1705017600000000)))


@pytest.fixture(scope="module")
def rows():
    """Random events: null keys, ties, reused and missing order ids, cents."""
    r = random.Random(11)
    out = []
    for _ in range(1500):
        day = r.choice(DAYS)
        name = r.choice([*CORE_STAGES, "page_view"])
        user = r.choice([None, "u1", "u1", "u1", "u2", "u3", *(f"v{i}" for i in range(20))])
        paid = name == "purchase"
        row = list(
            ev(
                name,
                START[day] + r.randrange(0, 24 * HOUR, HOUR // 4),
                user,
                r.choice([None, 1, 2, 3, 4]),
                day=day,
                device=r.choice([None, "desktop", "mobile"]),
                source=r.choice([None, "google", "mail"]),
                medium=r.choice([None, "organic"]),
                txn=r.choice([None, NOT_SET, *(f"t{i}" for i in range(40))]) if paid else None,
                revenue=r.choice([None, 10.1, 20.2, 30.3, 0.1]) if paid else None,
            )
        )
        listed = [(None if (i := r.randrange(6)) == 0 else f"i{i}", r.choice([None, f"n{i}"])) for _ in range(r.randint(0, 4))]
        row[9] = r.choice([None, listed, listed, listed])
        out.append(tuple(row))
    return out


@pytest.fixture(scope="module")
def events(spark, rows):
    return frame(spark, rows).repartition(5)


def _keys(row):
    return row[3], next((v[1] for k, v in row[4] if k == "ga_session_id"), None)


def test_products_equal_direct_counts(events, rows):
    seen = defaultdict(lambda: [Counter(), 0, defaultdict(set), set()])
    for row in rows:
        user, session = _keys(row)
        if row[2] not in CORE_STAGES:
            continue
        for item in {i for i, _ in row[9] or []}:
            entry = seen[item]
            entry[0][row[2]] += 1
            if row[2] == "purchase":
                entry[1] += sum(1 for i, _ in row[9] if i == item)
            if user is not None and session is not None:
                entry[2][row[2]].add((user, session))
            entry[3] |= {n for i, n in row[9] if i == item and n is not None}
    got = products.product_performance(events, PERIOD).collect()
    assert {r.item_id for r in got} == set(seen) and None in seen
    for r in got:
        counts, units, sessions, names = seen[r.item_id]
        assert [r[f"{s}_events"] for s in CORE_STAGES] == [counts[s] for s in CORE_STAGES]
        assert [r[f"{s}_sessions"] for s in CORE_STAGES] == [len(sessions[s]) for s in CORE_STAGES]
        assert r.purchase_units == units and r.item_name == max(names, default=None)
        both = len(sessions["view_item"] & sessions["add_to_cart"])
        assert r.view_item_to_add_to_cart_rate_pct == round(100 * (both / len(sessions["view_item"])), 2)
    assert len(products.product_performance(events, PERIOD, top=2).collect()) == 2
    assert products.product_performance(events.limit(0), PERIOD).collect() == []


def _orders(rows):
    orders = {}
    for row in rows:
        txn, paid = row[8]
        if row[2] == "purchase" and txn not in (None, NOT_SET):
            o = orders.setdefault((*_keys(row), txn), [row[1], None, row[0]])
            o[0] = min(o[0], row[1])
            o[2] = max(o[2], row[0])
            if paid is not None:
                o[1] = paid if o[1] is None else max(o[1], paid)
    return orders


@pytest.mark.parametrize("width", [1, HOUR, 7 * HOUR, 1000 * HOUR])
def test_attribution_equals_direct_links(events, rows, width):
    sessions = defaultdict(list)
    for row in rows:
        if None not in _keys(row):
            sessions[_keys(row)].append(row)
    touches = defaultdict(list)
    for (user, session), own in sessions.items():
        first = min(r[1] for r in own)
        pair = min((r[7][0] or "(direct)", r[7][1] or "(none)") for r in own if r[1] == first)
        device = min(((r[1], r[5][0]) for r in own if r[5][0] is not None), default=(0, "unknown"))[1]
        touches[user].append((first, -session, (*pair, device)))
    want = {}
    for key, (t, paid, _) in _orders(rows).items():
        earlier = [x for x in touches.get(key[0], []) if x[0] < t]
        want[key] = (t, paid, max(earlier)[2] if earlier else None)
    got = attribution.attributed_orders(events, PERIOD, width).collect()
    assert len(got) == len(want)
    for r in got:
        touch = None if r.touch is None else tuple(r.touch)
        assert (r.order_time, r.revenue, touch) == want[r.user_pseudo_id, r.ga_session_id, r.order_id]
    assert any(w[2] is None for w in want.values())


def test_attributed_revenue_adds_up_to_the_kpis(events):
    report = attribution.revenue_by_touch(events, PERIOD).collect()
    kpi = commerce.kpi_overview(events, PERIOD).first()
    assert sum(r.orders for r in report) == kpi.orders
    assert round(sum(r.revenue or 0 for r in report), 2) == kpi.revenue
    assert abs(sum(r.revenue_share_pct or 0 for r in report) - 100) < 0.1
    assert attribution.revenue_by_touch(events.limit(0), PERIOD).collect() == []


def test_attribution_reads_the_events_once(events):
    frame_ = attribution.revenue_by_touch(events, PERIOD)
    frame_.collect()
    plan = frame_._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan


def _ntile(n, total):
    size, larger = divmod(total, n)
    return [i + 1 for i in range(n) for _ in range(size + (i < larger))]


def test_customer_scores_equal_ntile(events, rows):
    users = defaultdict(lambda: ["", 0, 0.0])
    for (user, _, _), (_, paid, day) in _orders(rows).items():
        if user is not None:
            u = users[user]
            u[0], u[1], u[2] = max(u[0], day), u[1] + 1, round(u[2] + (paid or 0), 2)
    table = {
        u: ((dt.date(2024, 1, 12) - dt.datetime.strptime(d, "%Y%m%d").date()).days, n, m) for u, (d, n, m) in users.items()
    }
    tiles = _ntile(5, len(table))
    scores = defaultdict(list)
    for k in range(3):
        for tile, u in zip(tiles, sorted(table, key=lambda u: (table[u][k], u)), strict=True):
            scores[u].append(6 - tile if k == 0 else tile)
    got = customers.customer_scores(events, PERIOD).collect()
    assert {r.user_pseudo_id for r in got} == set(table)
    for r in got:
        assert (r.recency_days, r.frequency, r.monetary) == table[r.user_pseudo_id]
        assert [r.recency_score, r.frequency_score, r.monetary_score] == scores[r.user_pseudo_id]
    summary = customers.segment_summary(events, PERIOD).collect()
    assert sum(r.customers for r in summary) == len(table)
    assert Counter(r.segment for r in got) == {r.segment: r.customers for r in summary}
    assert customers.customer_scores(events.limit(0), PERIOD).collect() == []
    assert customers.segment_summary(events.limit(0), PERIOD).collect() == []


@pytest.mark.parametrize("total,n", [(0, 5), (1, 5), (4, 5), (5, 5), (13, 5), (1000, 7), (10, 1)])
def test_buckets_equal_ntile(spark, total, n):
    r = random.Random(total)
    values = [(r.choice([None, *range(6)]), f"k{i:04}") for i in range(total)]
    df = spark.createDataFrame(values, "v int, k string").repartition(4)
    got = {x.k: x.b for x in df.withColumn("b", bucket(["v", "k"], quantile_cuts(df, ["v", "k"], n))).collect()}
    ordered = sorted(values, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert got == {k: t for (_, k), t in zip(ordered, _ntile(n, total), strict=True)} if total else got == {}
    assert all(0 <= e < total - 1 for e in bucket_ends(total, n))


@pytest.mark.parametrize("width", [1, HOUR, 5 * HOUR, 1000 * HOUR])
def test_journeys_equal_direct_sequences(events, rows, width):
    sessions = defaultdict(list)
    for row in rows:
        if None not in _keys(row):
            sessions[_keys(row)].append((row[1], row[2]))
    want = Counter()
    for own in sessions.values():
        path = ["(start)", *(n for _, n in sorted(own)), "(exit)"]
        want.update(zip(path, path[1:]))
    got = journeys.journey_transitions(events, PERIOD, width=width).collect()
    assert {(r.from_event, r.to_event): r.transitions for r in got} == want
    for a in {a for a, _ in want}:
        assert abs(sum(r.share_of_from_pct for r in got if r.from_event == a) - 100) < 0.1


def test_journeys_of_named_events_and_of_none(events):
    got = journeys.journey_transitions(events, PERIOD, names=CORE_STAGES).collect()
    assert {r.from_event for r in got} == {*CORE_STAGES, "(start)"}
    assert journeys.journey_transitions(events.where(F.lit(False)), PERIOD).collect() == []


def test_journeys_read_the_events_once(events):
    frame_ = journeys.journey_transitions(events, PERIOD)
    frame_.collect()
    plan = frame_._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan
