"""Incremental daily tables: new days, then a late file for an existing day."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionflow.operators import commerce, quality
from sessionflow.sources.fixture import DerivedEventSource
from sessionflow.sources.parquet import ParquetEventSource, write_events
from sessionflow.streaming.daily import start_daily_updates
from tests.compare import _rows
from tests.conftest import SF_SMALL


def _same(a, b):
    return _rows(a.columns, a.collect()) == _rows(b.columns, b.collect())


def _run(spark, root, out, ckpt, operator, **kw):
    q = start_daily_updates(spark, root, out, ckpt, operator, **kw)
    q.awaitTermination(300)
    assert q.exception() is None


def test_daily_tables_follow_new_and_late_partitions(spark, tmp_path):
    root, out, ckpt = str(tmp_path / "events"), str(tmp_path / "kpi"), str(tmp_path / "ckpt")
    full = DerivedEventSource(spark, SF_SMALL).table()
    early = full.where(F.col("table_suffix") <= "20240115")
    late = full.where(F.col("table_suffix") > "20240115")

    write_events(early, root, files_per_day=1)
    _run(spark, root, out, ckpt, commerce.kpi_daily)
    got = spark.read.parquet(out)
    assert got.count() == 15
    want = commerce.kpi_daily(ParquetEventSource(spark, root), None)
    assert _same(got.select(*want.columns), want)

    # the rest of the days land
    write_events(late, root, files_per_day=1, mode="append")
    _run(spark, root, out, ckpt, commerce.kpi_daily)
    got = spark.read.parquet(out)
    want = commerce.kpi_daily(ParquetEventSource(spark, root), None)
    assert got.count() == 30
    assert _same(got.select(*want.columns), want)

    # a late file for an existing day: that day is recomputed in full
    extra = full.where(F.col("table_suffix") == "20240110").withColumn(
        "user_pseudo_id", F.concat(F.lit("late-"), F.col("user_pseudo_id"))
    )
    write_events(extra, root, files_per_day=1, mode="append")
    _run(spark, root, out, ckpt, commerce.kpi_daily)
    got = spark.read.parquet(out)
    want = commerce.kpi_daily(ParquetEventSource(spark, root), None)
    assert _same(got.select(*want.columns), want)
    day = got.where(F.col("event_date") == "2024-01-10").first()
    assert day.users > 0 and day.users == want.where(F.col("event_date") == "2024-01-10").first().users


def test_daily_event_counts_stream(spark, tmp_path):
    root, out, ckpt = str(tmp_path / "events"), str(tmp_path / "counts"), str(tmp_path / "ckpt")
    write_events(DerivedEventSource(spark, SF_SMALL).table(), root, files_per_day=1)
    # several micro-batches (7 files each), same final table
    _run(spark, root, out, ckpt, quality.daily_event_counts, max_files_per_trigger=7)
    got = spark.read.parquet(out)
    want = quality.daily_event_counts(ParquetEventSource(spark, root), None)
    assert _same(got.select(*want.columns), want)
