"""Run every statement over one event table and write each result.

The analysis is a sequence of statements over the same events: overviews,
quality checks, funnels and KPIs. ``run_all`` computes them all for the given
periods and writes each result (Parquet, or CSV) under ``out_dir/<name>``. Without an
official period, the runner takes the one that 09.2 implies (the day after
the last day without add-to-cart events, to the end of the review period),
the step the analyst otherwise does by hand.

    python -m sessionflow.reports EVENTS_ROOT OUT_DIR --review 20201101:20210131
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import commerce, funnel, overview, quality
from .schema import Period
from .sources.base import SourceLike, as_source
from .sources.parquet import ParquetEventSource


def statements(
    review: Period, official: Period, day: str, sessions: DataFrame | None = None
) -> dict[str, Callable[[SourceLike], DataFrame]]:
    """Statement name -> operator with the analysis parameters bound.

    ``sessions`` is the stored :func:`funnel.session_frame` of the official
    period; with it, five funnels read it instead of the events.
    """
    return {
        "01_event_counts": lambda s: overview.event_counts(s),
        "02_dataset_overview": lambda s: overview.dataset_overview(s),
        "03_sample_event_records": lambda s: overview.sample_records(s, day),
        "04_purchase_session_journey": lambda s: overview.purchase_session_journey(s, day),
        "05_presence_funnel": lambda s: funnel.presence_funnel(s, official),
        "06_funnel_dropoff": lambda s: funnel.funnel_dropoff(s, official, sessions=sessions),
        "07_funnel_by_device": lambda s: funnel.funnel_by_device(s, official, sessions=sessions),
        "08_funnel_by_first_source": lambda s: funnel.funnel_by_first_source(s, official, sessions=sessions),
        "09_1_daily_event_counts": lambda s: quality.daily_event_counts(s, review),
        "09_2_reliable_period": lambda s: quality.reliable_period(s, review),
        "09_3_missing_user_id": lambda s: quality.missing_user_id(s, official),
        "09_4_missing_session_id": lambda s: quality.missing_session_id(s, official),
        "10_ordered_funnel": lambda s: funnel.ordered_funnel(s, official, sessions=sessions),
        "10_presence_vs_ordered": lambda s: funnel.presence_vs_ordered(s, official, sessions=sessions),
        "11_1_purchase_quality": lambda s: commerce.purchase_quality(s, official),
        "11_2_revenue_anomalies": lambda s: commerce.revenue_anomalies(s, official),
        "11_3_anomalous_purchase_events": lambda s: commerce.anomalous_purchase_events(
            s, official
        ),
        "11_4_kpi_overview": lambda s: commerce.kpi_overview(s, official),
        "11_5_kpi_daily": lambda s: commerce.kpi_daily(s, official),
    }


#: Statements computed from one stored frame of sessions.
SHARED = frozenset(
    "06_funnel_dropoff 07_funnel_by_device 08_funnel_by_first_source 10_ordered_funnel "
    "10_presence_vs_ordered".split()
)


def run_all(
    source: SourceLike,
    out_dir: str,
    review: Period,
    official: Period | None = None,
    day: str | None = None,
    only: list[str] | None = None,
    fmt: str = "parquet",
) -> dict[str, str]:
    """Compute the statements and write each to ``out_dir/<name>`` as Parquet
    or, with ``fmt="csv"``, as CSV with a header (array columns as text).

    ``official`` defaults to the period 09.2 implies (``review`` when no day
    lacks add-to-cart events); ``day`` (03, 04) defaults to the last review
    day. The per-session funnel frame is computed once, stored beside the
    results while the funnels read it, then deleted. Returns name -> output
    path. Raises when the review period leaves no
    reliable day.
    """
    if official is None:
        official = quality.official_period(source, review)
        if official is None:
            raise ValueError(f"no reliable tracking day in {review.start}..{review.end}")
    day = day or review.end
    written = {}
    spark = as_source(source).scan(official).sparkSession
    shared = f"{out_dir.rstrip('/')}/_sessions"
    sessions = None
    if not only or len(SHARED.intersection(only)) > 1:
        funnel.session_frame(source, official).write.mode("overwrite").parquet(shared)
        sessions = spark.read.parquet(shared)
    for name, fn in statements(review, official, day, sessions).items():
        if only and name not in only:
            continue
        path = f"{out_dir.rstrip('/')}/{name}"
        df = fn(source)
        if fmt == "csv":
            arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
            as_text = [
                F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if c in arrays else c
                for c in df.columns
            ]
            df = df.select(*as_text)
            df.write.mode("overwrite").option("header", True).csv(path)
        elif fmt == "parquet":
            df.write.mode("overwrite").parquet(path)
        else:
            raise ValueError(f"unknown format {fmt!r}")
        written[name] = path
    if sessions is not None:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return written


def _period(text: str) -> Period:
    start, _, end = text.partition(":")
    return Period(start, end or start)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n\n")[0])
    p.add_argument("events_root", help="event table, partitioned by table_suffix=YYYYMMDD")
    p.add_argument("out_dir")
    p.add_argument("--review", required=True, type=_period, help="START:END suffixes")
    p.add_argument("--official", type=_period, help="START:END (default: from 09.2)")
    p.add_argument("--day", help="YYYYMMDD for 03 and 04 (default: end of review)")
    p.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("sessionflow-reports").getOrCreate()
    source = ParquetEventSource(spark, args.events_root)
    results = run_all(
        source, args.out_dir, args.review, args.official, args.day, fmt=args.format
    )
    for name, path in results.items():
        print(name, path)


if __name__ == "__main__":
    main()
