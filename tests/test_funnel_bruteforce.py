"""The ordered chain against a direct Python implementation on random sessions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sessionflow.operators import funnel
from tests.events import ev, frame

STAGES = list(funnel.CORE_STAGES)
NAMES = STAGES + ["page_view"]


def _greedy(events: list[tuple[str, int]]) -> list[int | None]:
    """Stage k = earliest stage-k time strictly after stage k-1's time."""
    out: list[int | None] = []
    prev = None
    for k, stage in enumerate(STAGES):
        times = [t for n, t in events if n == stage and (k == 0 or (prev is not None and t > prev))]
        prev = min(times) if times else None
        out.append(prev)
    return out


def _random_sessions(seed: int, n_sessions: int = 300):
    rnd = random.Random(seed)
    rows, expected = [], {}
    for i in range(n_sessions):
        user, session = f"u{i % 37}", i
        n = rnd.randint(1, 12)
        events = [(rnd.choice(NAMES), rnd.randint(0, 6)) for _ in range(n)]  # many ties
        rows += [ev(name, t, user, session) for name, t in events]
        if any(name == STAGES[0] for name, _ in events):
            expected[(user, session)] = _greedy(events)
    return rows, expected


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("widths", [funnel.BLOCK_WIDTHS, (1,), (2,), (3,), (1, 2), (2, 4, 12)])
def test_chain_matches_direct_greedy_at_any_block_width(spark, seed, widths):
    # times 0..6 with ties: many of them on and beside the edges of narrow blocks
    rows, expected = _random_sessions(seed)
    times = funnel.ordered_stage_times(frame(spark, rows), None, widths=widths).collect()
    got = {(r.user_pseudo_id, r.ga_session_id): [r._t0, r._t1, r._t2, r._t3] for r in times}
    assert got == expected


def test_segment_attribution_matches_direct_rule(spark):
    rnd = random.Random(5)
    rows, expected_dev, expected_src = [], {}, {}
    for i in range(250):
        user, session = f"u{i % 23}", i
        events = []
        for _ in range(rnd.randint(1, 8)):
            events.append((
                rnd.choice(NAMES), rnd.randint(0, 4),
                rnd.choice([None, "desktop", "mobile", "tablet"]),
                rnd.choice([None, "google", "shop"]), rnd.choice([None, "organic", "referral"]),
            ))
        rows += [ev(n, t, user, session, device=d, source=s, medium=m) for n, t, d, s, m in events]
        views = [e for e in events if e[0] == STAGES[0]]
        if views:
            with_dev = sorted((t, d) for _, t, d, _, _ in views if d is not None)
            expected_dev[(user, session)] = with_dev[0][1] if with_dev else None
            pairs = sorted((t, s or "(direct)", m or "(none)") for _, t, _, s, m in views)
            expected_src[(user, session)] = pairs[0][1:]
    df = frame(spark, rows)
    dev = funnel.ordered_stage_times(df, None, attributes={"d": (F.col("device.category"), True)})
    assert {(r.user_pseudo_id, r.ga_session_id): r.d for r in dev.collect()} == expected_dev
    by_device = funnel.funnel_by_device(df, None).collect()
    counts = {}
    for d in expected_dev.values():
        counts[d or "unknown"] = counts.get(d or "unknown", 0) + 1
    assert {r.device_category: r.view_item_sessions for r in by_device} == counts
    by_source = funnel.funnel_by_first_source(df, None, min_sessions=0, top=None).collect()
    counts = {}
    for p in expected_src.values():
        counts[p] = counts.get(p, 0) + 1
    assert {(r.first_user_source, r.first_user_medium): r.view_item_sessions for r in by_source} == counts


def test_hot_session_is_spread_over_its_blocks(spark):
    rnd = random.Random(9)
    events = [(rnd.choice(NAMES), rnd.randint(0, 2_999)) for _ in range(4_000)]
    rows = [ev(name, t, "bot", 1) for name, t in events] + [ev(STAGES[0], 5, "u", 2)]
    df = frame(spark, rows)
    blocks = funnel._summarise(funnel.stage_events(df, None, funnel.CORE_STAGES), 4, {}, 100)
    assert blocks.where("user_pseudo_id = 'bot'").count() == 30
    times = funnel.ordered_stage_times(df, None, widths=(100,)).where("user_pseudo_id = 'bot'").first()
    assert [times._t0, times._t1, times._t2, times._t3] == _greedy(events)


def test_no_row_holds_more_than_one_days_blocks(spark):
    """A bot session over many days: by default its days meet last, not its blocks."""
    day = 86_400_000_000
    rnd = random.Random(4)
    events = [(rnd.choice(NAMES), d * day + rnd.randrange(0, day, 5_000_000)) for d in range(20) for _ in range(200)]
    df = frame(spark, [ev(name, t, "bot", 1) for name, t in events])
    narrow, wide = funnel.BLOCK_WIDTHS
    assert wide == day and wide % narrow == 0
    blocks = funnel._summarise(funnel.stage_events(df, None, funnel.CORE_STAGES), 4, {}, narrow)
    per_day = blocks.groupBy(F.floor(F.col("_t") / wide)).count()
    assert per_day.agg(F.max("count")).first()[0] <= wide // narrow
    days = funnel._fold(blocks, 4, {}, wide)
    assert days.count() == 20 and blocks.count() > 2_000
    times = funnel.ordered_stage_times(df, None).first()
    assert [times._t0, times._t1, times._t2, times._t3] == _greedy(events)
