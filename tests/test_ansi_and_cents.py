"""Results do not depend on ANSI mode; revenue with cents sums and rounds."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from sessionflow.operators import commerce, overview
from tests.compare import _rows
from tests.conftest import SF_SMALL
from tests.events import DAY, ev, frame


@pytest.mark.parametrize(
    "name",
    ["sample_event_records", "purchase_quality", "revenue_anomalies", "anomalous_purchase_events",
     "kpi_overview", "kpi_daily"],
)
def test_ansi_mode_changes_nothing(spark, name):
    query = entry.queries()[name]
    df = query(spark, SF_SMALL)
    want = _rows(df.columns, df.collect(), exact=True)
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        df = query(spark, SF_SMALL)
        assert _rows(df.columns, df.collect(), exact=True) == want
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_null_items_have_no_count_in_either_mode(spark):
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            rows = overview.sample_records(frame(spark, [ev("view_item", 1, items=None)]), DAY).collect()
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
        assert [r.item_count for r in rows] == [None]


def test_cents(spark):
    rows = [ev("purchase", i, f"u{i}", i, txn=f"t{i}", revenue=r) for i, r in enumerate([10.01, 20.02, 0.1, 0.2])]
    rows.append(ev("purchase", 9, "u0", 0, txn="t0", revenue=9.99))  # a duplicate: the largest counts
    df = frame(spark, rows)
    total = commerce.kpi_overview(df, None).first()
    assert (total.orders, total.revenue, total.average_order_value) == (4, 30.33, 7.58)
    day = commerce.kpi_daily(df, None).first()
    assert (day.orders, day.revenue, day.revenue_per_session) == (4, 30.33, 7.58)


def test_malformed_date_raises(spark):
    rows = [ev("view_item", 1, day="2024011x"), ev("view_item", 2)]
    with pytest.raises(Exception, match="2024011x|CANNOT_PARSE_TIMESTAMP"):
        overview.dataset_overview(frame(spark, rows)).collect()
