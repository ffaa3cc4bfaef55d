"""Customer clusters: every customer labelled, planted groups found, stable runs."""

from __future__ import annotations

from collections import Counter

from sessionflow.operators import customers
from sessionflow.schema import Period
from tests.events import ev, frame

PERIOD = Period("20240101", "20240131")


def _rows():
    """Three kinds: many dear recent orders, few cheap old ones, one dear old order."""
    rows = []
    for i in range(60):
        rows += [ev("purchase", k, f"a{i}", k, day="20240130", txn=f"t{k}", revenue=100.0 + k) for k in range(10)]
        rows += [ev("purchase", k, f"b{i}", k, day="20240103", txn=f"t{k}", revenue=2.0 + (i % 3) / 10) for k in range(2)]
    rows += [ev("purchase", 1, f"c{i}", 1, day="20240102", txn="t", revenue=900.0 + i) for i in range(30)]
    rows += [ev("purchase", 1, None, 1, day="20240102", txn="t", revenue=900.0), ev("view_item", 1, "v", 1, day="20240102")]
    return rows


def test_planted_groups_are_found(spark):
    df = frame(spark, _rows())
    got = customers.customer_clusters(df, PERIOD, k=3).collect()
    assert len(got) == 150 and all(r.cluster is not None for r in got)
    kinds = {}
    for r in got:
        kinds.setdefault(r.user_pseudo_id[0], set()).add(r.cluster)
    # numbered by mean revenue: 1045, some 915, some 4
    assert kinds == {"a": {0}, "c": {1}, "b": {2}}
    profile = customers.cluster_profiles(df, PERIOD, k=3).collect()
    assert [(r.cluster, r.customers, r.average_frequency) for r in profile] == [(0, 60, 10.0), (1, 30, 1.0), (2, 60, 2.0)]


def test_runs_agree_however_the_events_are_dealt(spark):
    rows = _rows()
    sizes = {
        tuple(sorted(Counter(r.cluster for r in customers.customer_clusters(frame(spark, rows).repartition(n), PERIOD, k=4).collect()).items()))
        for n in (1, 5, 5)
    }
    assert len(sizes) == 1


def test_few_customers_and_none(spark):
    df = frame(spark, _rows())
    assert customers.customer_clusters(df.where("user_pseudo_id = 'a1'"), PERIOD, k=4).count() == 1
    none = customers.customer_clusters(df.limit(0), PERIOD)
    assert none.collect() == [] and none.columns == ["user_pseudo_id", "recency_days", "frequency", "monetary", "cluster"]
