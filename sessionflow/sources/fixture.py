"""Event layout derived from the flat test tables (``events`` + ``nation``).

The test data holds a flat click log ``events(event_id, ts, user_id,
event_type, value, props)``. This source maps it, row by row, onto the nested
event layout and adds what the statements need to be exercised: sessions that
span days, equal timestamps, missing users / sessions, placeholder and reused
transaction ids, conflicting revenue, zero-cart days. The mapping is a fixed,
deterministic function of each row (plus one lookup of the 25-row ``nation``
dimension), so an independent SQL engine can derive the same view.

Scans push the period down as a ``ts`` range (a Parquet row-group filter) and
the event-name list as an ``event_type IN`` filter on the raw column; the exact
predicates on the derived columns are applied on top.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NOT_SET, SESSION_PARAM, Period

# Fixed values of the derivation (identical in the SQL oracle):
# raw type -> event name; clicks are logged as page_view on even days of the
# month up to LAST_BROKEN_CART_DAY (the broken add_to_cart tracking days).
NAME_OF_TYPE = {
    "view": "view_item",
    "signup": "begin_checkout",
    "purchase": "purchase",
    "click": "add_to_cart",
    "error": "page_view",
}
LAST_BROKEN_CART_DAY = "2024-01-08"
# modulus rules on event_id: missing user 97, missing session 89,
# '(not set)' txn 20, null txn 33, reused txn 5 (id 'R' + event_id % 500),
# missing revenue 7, null items 5 (else event_id % 5 - 1 items)
MISSING_USER_MOD = 97
MISSING_SESSION_MOD = 89
NOT_SET_TXN_MOD = 20
NULL_TXN_MOD = 33
REUSED_TXN_MOD = 5
REUSED_TXN_RANGE = 500
MISSING_REVENUE_MOD = 7
NULL_ITEMS_MOD = 5
# items: number (user_id * 3 + session + j * (event_id % 3)) % ITEM_COUNT at
# place j of the list; no id at multiples of 40, no name at multiples of 7
ITEM_COUNT, NULL_ITEM_ID_MOD, NULL_ITEM_NAME_MOD = 200, 40, 7
SESSION_DAYS = 3  # a session is a user's 3-day block since 1970-01-01
REVENUE_STEP = 20  # revenue = floor(value / 20) * 20
# device by (user_id + hours since epoch) % 4
DEVICE_BY_MOD4 = ("desktop", "mobile", "tablet", None)
# acquisition by user_id % 5; user_id % 50 == 7 has source 'rare'
SOURCE_BY_MOD5 = ("google", None, "shop.example", "(data deleted)", "newsletter")
MEDIUM_BY_MOD5 = ("organic", None, "referral", "(data deleted)", "email")
RARE_SOURCE = "rare"
RARE_SOURCE_MOD, RARE_SOURCE_REM = 50, 7
NATION_COUNT = 25  # country = nation.n_name of n_nationkey = user_id % 25


def _sql_str(v: str | None) -> str:
    return "CAST(NULL AS STRING)" if v is None else "'" + v.replace("'", "''") + "'"


def _sql_case(key: str, values: Sequence[str | None]) -> str:
    arms = " ".join(f"WHEN {i} THEN {_sql_str(v)}" for i, v in enumerate(values) if v is not None)
    return f"CASE {key} {arms} ELSE CAST(NULL AS STRING) END"


def _param_sql(key: str, int_value: str) -> str:
    return (
        f"named_struct('key', '{key}', 'value', named_struct("
        "'string_value', CAST(NULL AS STRING), "
        f"'int_value', CAST({int_value} AS BIGINT), "
        "'float_value', CAST(NULL AS DOUBLE), 'double_value', CAST(NULL AS DOUBLE)))"
    )


def _derivation_sql() -> list[str]:
    """The mapping as SQL expressions over (events, nation) columns.

    Written as expression text and parsed once on the JVM (``selectExpr``):
    building the same tree through Python ``Column`` calls costs hundreds of
    driver round trips per query.
    """
    day = "CAST(ts AS DATE)"
    day_no = f"CAST(datediff({day}, DATE'1970-01-01') AS BIGINT)"
    hour_no = f"({day_no} * 24 + hour(ts))"
    session_no = f"CAST(floor({day_no} / {SESSION_DAYS}) AS BIGINT)"
    arms = []
    for raw, ga in NAME_OF_TYPE.items():
        value = f"'{ga}'"
        if raw == "click":
            value = (
                f"CASE WHEN dayofmonth({day}) % 2 = 0 AND {day} <= DATE'{LAST_BROKEN_CART_DAY}' "
                f"THEN 'page_view' ELSE {value} END"
            )
        arms.append(f"WHEN '{raw}' THEN {value}")
    event_name = f"CASE event_type {' '.join(arms)} ELSE event_type END"
    # the integer value of key "k" in the props object ({"k": n}): the digits
    # after the key by position, since no statement reads it but every scanned
    # row builds the array it stands in
    k_value = (
        "try_cast(trim(split_part(split_part(substring_index(props, '\"k\":', -1), ',', 1), '}', 1)) AS BIGINT)"
    )
    params = (
        f"CASE WHEN event_id % {MISSING_SESSION_MOD} = 0 THEN array({_param_sql('k', k_value)}) "
        f"ELSE array({_param_sql('k', k_value)}, {_param_sql(SESSION_PARAM, session_no)}) END"
    )
    source = (
        f"CASE WHEN user_id % {RARE_SOURCE_MOD} = {RARE_SOURCE_REM} THEN '{RARE_SOURCE}' "
        f"ELSE {_sql_case('user_id % 5', SOURCE_BY_MOD5)} END"
    )
    medium = _sql_case("user_id % 5", MEDIUM_BY_MOD5)
    txn = (
        "CASE WHEN event_type <> 'purchase' THEN CAST(NULL AS STRING) "
        f"WHEN event_id % {NOT_SET_TXN_MOD} = 0 THEN '{NOT_SET}' "
        f"WHEN event_id % {NULL_TXN_MOD} = 0 THEN CAST(NULL AS STRING) "
        f"WHEN event_id % {REUSED_TXN_MOD} = 0 "
        f"THEN concat('R', CAST(event_id % {REUSED_TXN_RANGE} AS STRING)) "
        f"ELSE concat('T', CAST(user_id AS STRING), '-', CAST({session_no} AS STRING)) END"
    )
    revenue = (
        f"CASE WHEN event_type = 'purchase' AND event_id % {MISSING_REVENUE_MOD} <> 0 "
        f"THEN CAST(floor(value / {REVENUE_STEP}) * {REVENUE_STEP} AS DOUBLE) END"
    )
    # an event's first item belongs to the user and session, so a session's
    # events share items; the others step on by event_id % 3 (0: units of one item)
    item_no = f"((user_id * 3 + {session_no} + j * (event_id % 3)) % {ITEM_COUNT})"
    items = (
        f"CASE WHEN event_id % {NULL_ITEMS_MOD} <> 0 THEN transform(slice(array(0, 1, 2), 1, "
        f"CAST(event_id % {NULL_ITEMS_MOD} - 1 AS INT)), j -> named_struct("
        f"'item_id', CASE WHEN {item_no} % {NULL_ITEM_ID_MOD} <> 0 THEN concat('SKU-', CAST({item_no} AS STRING)) END, "
        f"'item_name', CASE WHEN {item_no} % {NULL_ITEM_NAME_MOD} <> 0 THEN concat('Item ', CAST({item_no} AS STRING)) END)) END"
    )
    device = _sql_case(f"(user_id + {hour_no}) % 4", DEVICE_BY_MOD4)
    suffix = f"date_format({day}, 'yyyyMMdd')"
    return [
        f"{suffix} AS event_date",
        f"{hour_no} * 3600000000 AS event_timestamp",
        f"{event_name} AS event_name",
        f"CASE WHEN event_id % {MISSING_USER_MOD} <> 0 THEN CAST(user_id AS STRING) END "
        "AS user_pseudo_id",
        f"{params} AS event_params",
        f"named_struct('category', {device}) AS device",
        "named_struct('country', _country) AS geo",
        f"named_struct('source', {source}, 'medium', {medium}) AS traffic_source",
        f"named_struct('transaction_id', {txn}, 'purchase_revenue', {revenue}) AS ecommerce",
        f"{items} AS items",
        f"{suffix} AS table_suffix",
    ]


_DERIVATION = _derivation_sql()

def derive_events(events: DataFrame, nation: DataFrame | None) -> DataFrame:
    """Map the flat click log onto the nested event layout (narrow, no shuffle).

    The country comes from a left join with ``nation``; None leaves it null.
    """
    if nation is None:
        return events.withColumn("_country", F.lit(None).cast("string")).selectExpr(*_DERIVATION)
    dim = nation.selectExpr("CAST(n_nationkey AS BIGINT) AS _nation_key", "n_name AS _country")
    joined = events.join(dim, (F.col("user_id") % NATION_COUNT) == F.col("_nation_key"), "left")
    return joined.selectExpr(*_DERIVATION)


def _raw_types(names: Sequence[str]) -> list[str]:
    """Raw ``event_type`` values that can produce one of ``names``."""
    out = set()
    for n in names:
        hits = [raw for raw, ga in NAME_OF_TYPE.items() if ga == n]
        if n == "page_view":
            hits.append("click")
        if not hits and n not in NAME_OF_TYPE:
            hits.append(n)  # unmapped types pass through unchanged
        out.update(hits)
    return sorted(out)


def _ts_literal(suffix: str, plus_days: int = 0) -> Column:
    d = dt.date(int(suffix[:4]), int(suffix[4:6]), int(suffix[6:])) + dt.timedelta(plus_days)
    return F.lit(f"{d.isoformat()} 00:00:00").cast("timestamp_ntz")


# Column types of the flat test tables (read with an explicit schema: no
# footer inference per query).
RAW_SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
}


class DerivedEventSource:
    """Event source over ``{sf_dir}/events.parquet`` and ``{sf_dir}/nation.parquet``.

    Only statement 03 reads the country, so only a source made with
    ``with_country`` joins the nations; elsewhere the country is null.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, with_country: bool = False):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.with_country = with_country

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def _derive(self, events: DataFrame) -> DataFrame:
        return derive_events(events, self._read("nation") if self.with_country else None)

    def table(self) -> DataFrame:
        return self._derive(self._read("events"))

    def scan(
        self, period: Period | None = None, names: Sequence[str] | None = None
    ) -> DataFrame:
        raw = self._read("events")
        if period is not None:
            # suffix = date(ts), so the suffix range is exactly this ts range
            raw = raw.where(
                (F.col("ts") >= _ts_literal(period.start))
                & (F.col("ts") < _ts_literal(period.end, plus_days=1))
            )
        if names is not None:
            raw = raw.where(F.col("event_type").isin(_raw_types(names)))
        df = self._derive(raw)
        # (the ts range above is the suffix range exactly: no second predicate)
        if names is not None:
            df = df.where(F.col("event_name").isin(list(names)))
        return df


# Analysis periods of the test tables (2024-01-01 .. 2024-01-30): the review
# period covers all days, the official period starts the day after the last
# zero-add_to_cart day, the sample day is the last day.
FIXTURE_REVIEW = Period("20240101", "20240130")
FIXTURE_OFFICIAL = Period("20240109", "20240130")
FIXTURE_DAY = "20240130"
# prediction days; labels of the first two end before the last one
PROPENSITY_DAYS = (dt.date(2024, 1, 9), dt.date(2024, 1, 15), dt.date(2024, 1, 23))
