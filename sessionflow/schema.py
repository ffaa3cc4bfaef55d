"""Event-log schema, funnel vocabulary and analysis periods.

The event table is one row per user event with nested device / geo /
traffic-source / ecommerce records and repeated ``event_params`` and
``items`` records. Daily shards become one Parquet table partitioned by
``table_suffix`` (``YYYYMMDD`` string), so a shard range is a partition
filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

PARAM_VALUE = T.StructType(
    [
        T.StructField("string_value", T.StringType()),
        T.StructField("int_value", T.LongType()),
        T.StructField("float_value", T.DoubleType()),
        T.StructField("double_value", T.DoubleType()),
    ]
)

EVENT_PARAM = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("value", PARAM_VALUE)]
)

ITEM = T.StructType(
    [T.StructField("item_id", T.StringType()), T.StructField("item_name", T.StringType())]
)

# Column order of the stored table; ``table_suffix`` is the partition column.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_date", T.StringType()),
        T.StructField("event_timestamp", T.LongType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("user_pseudo_id", T.StringType()),
        T.StructField("event_params", T.ArrayType(EVENT_PARAM)),
        T.StructField("device", T.StructType([T.StructField("category", T.StringType())])),
        T.StructField("geo", T.StructType([T.StructField("country", T.StringType())])),
        T.StructField(
            "traffic_source",
            T.StructType(
                [T.StructField("source", T.StringType()), T.StructField("medium", T.StringType())]
            ),
        ),
        T.StructField(
            "ecommerce",
            T.StructType(
                [
                    T.StructField("transaction_id", T.StringType()),
                    T.StructField("purchase_revenue", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("items", T.ArrayType(ITEM)),
        T.StructField("table_suffix", T.StringType()),
    ]
)

# Fixed values (must equal the reference's for matching results):
# core funnel event names in funnel order, their report labels, the event names
# shown in the single-session journey, the missing-transaction placeholder, the
# session-id parameter key, the fallback labels of the segmented funnels.
CORE_STAGES = ("view_item", "add_to_cart", "begin_checkout", "purchase")
STAGE_LABELS = ("View Item", "Add to Cart", "Begin Checkout", "Purchase")
JOURNEY_EVENTS = (
    "session_start",
    "view_item",
    "add_to_cart",
    "begin_checkout",
    "add_shipping_info",
    "add_payment_info",
    "purchase",
)
NOT_SET = "(not set)"
SESSION_PARAM = "ga_session_id"
UNKNOWN_DEVICE = "unknown"
DIRECT_SOURCE = "(direct)"
NONE_MEDIUM = "(none)"


@dataclass(frozen=True)
class Period:
    """Inclusive range of ``YYYYMMDD`` shard suffixes."""

    start: str
    end: str

    def __post_init__(self) -> None:
        for v in (self.start, self.end):
            if len(v) != 8 or not v.isdigit():
                raise ValueError(f"suffix must be YYYYMMDD, got {v!r}")
        if self.start > self.end:
            raise ValueError(f"empty period {self.start}..{self.end}")

    @classmethod
    def day(cls, suffix: str) -> "Period":
        return cls(suffix, suffix)


# Periods of the published analysis (reference data: 2020-11-01 .. 2021-01-31).
REVIEW_PERIOD = Period("20201101", "20210131")
OFFICIAL_PERIOD = Period("20201125", "20210131")
SAMPLE_DAY = "20210131"
