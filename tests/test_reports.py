"""The runner writes every statement; the official period comes from 09.2."""

from __future__ import annotations

import __spark_entry__ as entry
from sessionflow.reports import run_all, statements
from sessionflow.schema import Period
from sessionflow.sources.fixture import FIXTURE_DAY, FIXTURE_OFFICIAL, FIXTURE_REVIEW, DerivedEventSource
from tests.compare import _rows
from tests.conftest import SF_SMALL


def test_runner_writes_every_statement_with_the_derived_period(spark, tmp_path):
    src = DerivedEventSource(spark, SF_SMALL)
    out = str(tmp_path / "out")
    written = run_all(src, out, FIXTURE_REVIEW)
    assert set(written) == set(statements(FIXTURE_REVIEW, FIXTURE_OFFICIAL, FIXTURE_DAY))
    # 09.2 gives 2024-01-09 as the reliable start: the official period of the
    # registered queries, so the written results equal them
    pairs = {
        "10_ordered_funnel": "ordered_funnel",
        "11_4_kpi_overview": "kpi_overview",
        "04_purchase_session_journey": "purchase_session_journey",
        "11_3_anomalous_purchase_events": "anomalous_purchase_events",
    }
    pairs |= {
        "06_funnel_dropoff": "funnel_dropoff",
        "07_funnel_by_device": "funnel_by_device",
        "08_funnel_by_first_source": "funnel_by_first_source",
        "10_presence_vs_ordered": "presence_vs_ordered",
    }
    for name, query in pairs.items():
        got = spark.read.parquet(written[name])
        want = entry.queries()[query](spark, SF_SMALL)
        assert _rows(got.columns, got.collect()) == _rows(want.columns, want.collect()), name


def test_shared_funnels_do_not_scan_the_events_again(spark, tmp_path):
    from sessionflow.operators import funnel
    from sessionflow.reports import SHARED

    src = DerivedEventSource(spark, SF_SMALL)
    path = str(tmp_path / "sessions")
    funnel.session_frame(src, FIXTURE_OFFICIAL).write.parquet(path)
    shared = statements(FIXTURE_REVIEW, FIXTURE_OFFICIAL, FIXTURE_DAY, spark.read.parquet(path))
    for name in SHARED:
        text = shared[name](src)._jdf.queryExecution().executedPlan().toString()
        assert "events.parquet" not in text, name


def test_runner_subset_and_explicit_period(spark, tmp_path):
    src = DerivedEventSource(spark, SF_SMALL)
    written = run_all(
        src, str(tmp_path / "o"), FIXTURE_REVIEW, Period("20240115", "20240130"),
        only=["05_presence_funnel"],
    )
    assert list(written) == ["05_presence_funnel"]
    assert spark.read.parquet(written["05_presence_funnel"]).count() == 4


def test_command_line_over_a_partitioned_table(spark, tmp_path, capsys):
    from sessionflow.reports import main
    from sessionflow.sources.parquet import write_events

    root = str(tmp_path / "events")
    write_events(DerivedEventSource(spark, SF_SMALL).table(), root, files_per_day=1)
    main([root, str(tmp_path / "out"), "--review", "20240101:20240130"])
    printed = capsys.readouterr().out.split("\n")
    assert len([line for line in printed if line]) == 19
    got = spark.read.parquet(str(tmp_path / "out" / "10_ordered_funnel"))
    assert [r.sessions for r in got.orderBy("step_number").collect()] == [80, 37, 13, 2]


def test_runner_csv_output(spark, tmp_path):
    src = DerivedEventSource(spark, SF_SMALL)
    written = run_all(
        src, str(tmp_path / "c"), FIXTURE_REVIEW, FIXTURE_OFFICIAL,
        only=["10_ordered_funnel", "11_2_revenue_anomalies"], fmt="csv",
    )
    funnel_rows = spark.read.option("header", True).csv(written["10_ordered_funnel"]).collect()
    assert sorted(int(r.sessions) for r in funnel_rows) == [2, 13, 37, 80]
    anomalies = spark.read.option("header", True).csv(written["11_2_revenue_anomalies"])
    assert anomalies.count() == 22 and "recorded_revenue_values" in anomalies.columns
