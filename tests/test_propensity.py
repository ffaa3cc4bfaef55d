"""Point-in-time features, the held-out model and ranking metrics."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sessionflow.operators import propensity
from sessionflow.schema import CORE_STAGES
from sessionflow.sources.fixture import DerivedEventSource
from tests.events import ev, frame

DAY0 = dt.date(2024, 1, 1)
CUTS = propensity.Cutoffs(tuple(DAY0 + dt.timedelta(d) for d in (6, 9, 14)), lookback=5, horizon=4)


def _day(i):
    return (DAY0 + dt.timedelta(i)).strftime("%Y%m%d")


def _rows(seed=3, n=1200):
    r = random.Random(seed)
    return [
        ev(r.choice([*CORE_STAGES, "page_view"]), i, r.choice([None, "hot", "hot", *(f"u{j}" for j in range(30))]), 1, day=_day(r.randrange(22)))
        for i in range(n)
    ]


def _plain(rows):
    days = defaultdict(list)
    for row in rows:
        if row[3] is not None:
            days[row[3]].append((dt.datetime.strptime(row[0], "%Y%m%d").date(), row[2]))
    out = {}
    for user, events in days.items():
        for cut in CUTS.days:
            past = [(d, n) for d, n in events if cut - dt.timedelta(CUTS.lookback) <= d < cut]
            future = [n for d, n in events if cut <= d < cut + dt.timedelta(CUTS.horizon)]
            if past:
                counts = [sum(n == s for _, n in past) for s in CORE_STAGES]
                out[user, cut] = (*counts, len(past), len({d for d, _ in past}), (cut - max(d for d, _ in past)).days, int("purchase" in future))
    return out


def _got(frame_):
    names = [*propensity.feature_names(), "label"]
    return {(r.user_pseudo_id, r.cutoff): tuple(r[n] for n in names) for r in frame_.collect()}


def test_features_equal_direct_counts(spark):
    rows = _rows()
    assert _got(propensity.propensity_features(frame(spark, rows).repartition(4), CUTS)) == _plain(rows)
    assert propensity.propensity_features(frame(spark, rows).limit(0), CUTS).collect() == []


def test_later_events_change_no_feature(spark):
    rows, cut = _rows(), max(CUTS.days)
    later = [ev(s, 10**9 + i, u, 1, day=cut.strftime("%Y%m%d")) for i, s in enumerate(CORE_STAGES) for u in ("hot", "u1", "u2")]
    one = _got(propensity.propensity_features(frame(spark, rows), CUTS))
    two = _got(propensity.propensity_features(frame(spark, rows + later), CUTS))
    # the last cutoff sees them as labels only; earlier ones end before that day
    assert {k: v[:-1] for k, v in one.items()} == {k: v[:-1] for k, v in two.items()}
    assert all(two["hot", c][-1] == one["hot", c][-1] for c in CUTS.days[:-1])
    assert two["u1", cut][-1] == 1


def test_cutoffs_are_checked():
    with pytest.raises(ValueError):
        propensity.propensity_features(None, propensity.Cutoffs(()))
    assert CUTS.period().start == _day(1) and CUTS.period().end == _day(17)


def _auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_ranking_metrics_equal_pair_counts(spark):
    r = random.Random(2)
    pairs = [(r.choice([0.0, 0.5, *(r.random() for _ in range(3))]), int(r.random() < 0.3)) for _ in range(700)]
    df = spark.createDataFrame(pairs + [(None, 1), (0.3, None)], "score double, label int").repartition(6)
    got = propensity.ranking_metrics(df, bins=10).collect()
    assert {x.area_under_curve for x in got} == {round(_auc(pairs), 6)}
    assert sum(x.rows for x in got) == 700 and sum(x.positives for x in got) == sum(y for _, y in pairs)
    above = sorted((s for s, _ in pairs), reverse=True)
    for x in got:
        own = [(s, y) for s, y in pairs if above.index(s) * 10 // 700 + 1 == x.bin]
        assert (x.rows, x.positives) == (len(own), sum(y for _, y in own))
        assert (x.highest_score, x.lowest_score) == (max(own)[0], min(own)[0])
    one = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    assert [x.area_under_curve for x in propensity.ranking_metrics(one, 1).collect()] == [None]
    assert propensity.ranking_metrics(one.limit(0)).collect() == []


def test_model_finds_a_planted_signal(spark):
    """Users with carts buy later; the model ranks them first on the held-out cutoff."""
    r = random.Random(9)
    rows = []
    for u in range(400):
        keen = u % 4 == 0
        for d in range(22):
            if r.random() < 0.4:
                rows.append(ev("add_to_cart" if keen else "view_item", d, f"u{u}", 1, day=_day(d)))
            if r.random() < (0.25 if keen else 0.02):
                rows.append(ev("purchase", d, f"u{u}", 1, day=_day(d)))
    cuts = propensity.Cutoffs(tuple(DAY0 + dt.timedelta(d) for d in (6, 9, 14)), lookback=5, horizon=4)
    scored = propensity.held_out_scores(frame(spark, rows), cuts)
    assert {x.cutoff for x in scored.select("cutoff").distinct().collect()} == {cuts.days[-1]}
    area = propensity.ranking_metrics(scored).first().area_under_curve
    assert area > 0.75
    with pytest.raises(ValueError):
        propensity.held_out_scores(frame(spark, rows), propensity.Cutoffs(cuts.days[:1]))


def test_model_on_the_event_view(spark):
    from __spark_entry__ import PROPENSITY_CUTOFFS

    src = DerivedEventSource(spark, "/root/testdata/sf0.01")
    scored = propensity.held_out_scores(src, PROPENSITY_CUTOFFS)
    rows = scored.collect()
    assert rows and all(0 <= r.score <= 1 for r in rows)
    users = propensity.propensity_features(src, PROPENSITY_CUTOFFS).where(F.col("cutoff") == max(PROPENSITY_CUTOFFS.days))
    assert len(rows) == users.count()
