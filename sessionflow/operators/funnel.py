"""Session funnels: presence (05), ordered (10), drop-off (06), by device (07),
by first-user acquisition (08), and presence-vs-ordered (C1).

A session is the pair (``user_pseudo_id``, ``ga_session_id``).

Ordered funnel semantics (greedy chain, strict order): ``t0`` is the first
time of stage 0 in the session; ``t_k`` is the first time of stage ``k``
strictly after ``t_{k-1}``; a missing stage ends the chain. Equal timestamps
never count as progress.

Physical plan of the ordered chain (``ordered_stage_times``), the same for
all data: one scan; the events of a session's time block become one row, which
is summarised by itself; blocks are folded by wider blocks, those by session.
A session of any size is spread over its blocks, and no task holds more of it
than the distinct times of one narrow block, the narrow blocks of one wide
block, or its wide blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.exprs import pct_sql, session_id, text_sql
from ..plans.report import rows_from_one
from ..schema import (
    CORE_STAGES,
    DIRECT_SOURCE,
    NONE_MEDIUM,
    OFFICIAL_PERIOD,
    STAGE_LABELS,
    UNKNOWN_DEVICE,
    Period,
)
from ..sources.base import SourceLike, as_source

USER, SESSION = "user_pseudo_id", "ga_session_id"
KEYS = (USER, SESSION)
_STAGE, _T = "_stage", "_t"


#: Widths in microseconds of the time blocks that a session is folded by, each
#: a multiple of the one before: ten seconds hold at most ten million times, a
#: day 8,640 of these, and a session as many days as the period has.
BLOCK_WIDTHS = (10_000_000, 86_400_000_000)


def _check_stages(stages: Sequence[str], labels: Sequence[str] | None) -> list[str]:
    stages = list(stages)
    if len(stages) < 2:
        raise ValueError("a funnel needs at least two stages")
    if len(set(stages)) != len(stages):
        raise ValueError(f"stage names must be distinct: {stages}")
    if labels is None:
        if stages == list(CORE_STAGES):
            return list(STAGE_LABELS)
        return [s.replace("_", " ").title() for s in stages]
    if len(labels) != len(stages):
        raise ValueError("one label per stage")
    return list(labels)


def _stage_index(stages: Sequence[str]) -> Column:
    arms = " ".join(f"WHEN {text_sql(s)} THEN {i}" for i, s in enumerate(stages))
    return F.expr(f"CASE event_name {arms} END")


def stage_events(
    source: SourceLike,
    period: Period | None,
    stages: Sequence[str],
    attributes: dict[str, Column] | None = None,
    require_user: bool = True,
) -> DataFrame:
    """Stage events with a session id (and a user unless ``require_user`` is
    false): (user, session, ``_stage``, ``_t``, attributes)."""
    attributes = attributes or {}
    ev = as_source(source).scan(period, stages)
    ev = ev.select(
        F.col(USER),
        session_id().alias(SESSION),
        _stage_index(stages).alias(_STAGE),
        F.col("event_timestamp").alias(_T),
        *[c.alias(n) for n, c in attributes.items()],
    )
    valid = F.col(SESSION).isNotNull()
    if require_user:
        valid = valid & F.col(USER).isNotNull()
    return ev.where(valid)


def _step(entry: int, stage: int) -> str:
    """Column with the time of ``stage`` for a session that needs ``entry`` next."""
    return f"_s{entry}_{stage}"


def _steps(n: int) -> list[tuple[int, int]]:
    return [(j, k) for j in range(n) for k in range(j, n)]


def _carried(n: int, attributes: dict[str, tuple[Column, bool]]) -> list[Column]:
    return [F.expr(f"bool_or(_p{k}) AS _p{k}") for k in range(n)] + [
        F.expr(f"min(`{a}`) AS `{a}`") for a in attributes
    ]


def _block(width: int) -> Column:
    """Start of the time's block: exact integer arithmetic."""
    return F.expr(f"{_T} - pmod({_T}, {width}L) AS {_T}")


# The chain's expressions are written as text and parsed on the JVM: building
# them through Python columns takes longer than running them on a small table.


def _summarise(ev: DataFrame, n: int, attributes: dict[str, tuple[Column, bool]], width: int) -> DataFrame:
    """Per session and block: for each stage that may be needed next, the
    times of the stages that the block alone then reaches; which stages occur;
    and the attribute values of its earliest stage-0 event (wrapped, so a null
    is a value; ties: the smallest).

    Equal times of a stage are one entry of its set already before the shuffle.
    """
    aggs = [f"collect_set(CASE WHEN {_STAGE} = {k} THEN {_T} END) AS _a{k}" for k in range(n)]
    for a, (_, ignore_nulls) in attributes.items():
        counts = f"{_STAGE} = 0" + (f" AND `{a}` IS NOT NULL" if ignore_nulls else "")
        aggs.append(f"min(CASE WHEN {counts} THEN struct({_T} AS t, `{a}` AS v) END) AS `{a}`")
    blocks = ev.groupBy(*KEYS, _block(width)).agg(*map(F.expr, aggs))
    blocks = blocks.selectExpr(
        "*",
        *[f"size(_a{k}) > 0 AS _p{k}" for k in range(n)],
        *[f"array_min(_a{k}) AS {_step(k, k)}" for k in range(n)],
    )
    for d in range(1, n):  # a projection per step: a time is computed once, then used
        blocks = blocks.selectExpr(
            "*",
            *[f"array_min(filter(_a{j + d}, t -> t > {_step(j, j + d - 1)})) AS {_step(j, j + d)}" for j in range(n - d)],
        )
    return blocks.drop(*[f"_a{k}" for k in range(n)])


def _fold(blocks: DataFrame, n: int, attributes: dict, width: int | None) -> DataFrame:
    """Join the blocks of each wider block (None: of each session) in time order.

    From every entry stage, a block continues at the first stage that the
    blocks before it have not reached.
    """
    keys = [*KEYS] if width is None else [*KEYS, _block(width)]
    names = ", ".join(_step(j, k) for j, k in _steps(n))
    listed = F.expr(f"sort_array(collect_list(struct({_T} AS at, {names}))) AS _blocks")
    joined = blocks.groupBy(*keys).agg(listed, *_carried(n, attributes))
    entries = range(1) if width is None else range(n)  # a session begins at stage 0

    def run(j: int) -> str:
        none = ", ".join(f"CAST(NULL AS BIGINT) AS k{k}" for k in range(j, n))
        after = []
        for k in range(j, n):
            arms = " ".join(f"WHEN acc.k{s} IS NULL THEN b.{_step(s, k)}" for s in range(j, k + 1))
            after.append(f"coalesce(acc.k{k}, CASE {arms} END) AS k{k}")
        return f"aggregate(_blocks, struct({none}), (acc, b) -> struct({', '.join(after)})) AS _e{j}"

    kept = [c for c in joined.columns if c != "_blocks"]
    folded = joined.selectExpr(*[f"`{c}`" for c in kept], *map(run, entries))
    return folded.selectExpr(
        *[f"`{c}`" for c in kept], *[f"_e{j}.k{k} AS {_step(j, k)}" for j in entries for k in range(j, n)]
    )


def ordered_stage_times(
    source: SourceLike,
    period: Period | None = OFFICIAL_PERIOD,
    stages: Sequence[str] = CORE_STAGES,
    attributes: dict[str, tuple[Column, bool]] | None = None,
    widths: Sequence[int] = BLOCK_WIDTHS,
    require_user: bool = True,
    presence: bool = False,
) -> DataFrame:
    """Per session that reached stage 0: ``_t0 .. _t{n-1}`` (null = not reached).

    With ``presence``, also ``_p0 .. _p{n-1}``: the stage occurs anywhere in
    the session. With ``require_user=False`` sessions with a null user are
    kept (the presence funnel keeps them; the ordered funnel does not).
    ``attributes`` maps a name to ``(value, ignore_nulls)``: the value on the
    session's earliest stage-0 event (ties: smallest value).

    Blocks are disjoint in time, so strict order holds between them and the
    result does not depend on ``widths`` (narrow to wide, each a multiple of
    the one before). Nothing runs while the plan is built.
    """
    stages = list(stages)
    n = len(stages)
    attributes = attributes or {}
    ev = stage_events(
        source, period, stages, {a: c for a, (c, _) in attributes.items()}, require_user
    )
    blocks = _summarise(ev, n, attributes, widths[0])
    for width in widths[1:]:
        blocks = _fold(blocks, n, attributes, width)
    sessions = _fold(blocks, n, attributes, None)
    return sessions.where(F.col(_step(0, 0)).isNotNull()).select(
        *KEYS,
        *[F.col(a)["v"].alias(a) for a in attributes],
        *[F.col(_step(0, k)).alias(f"_t{k}") for k in range(n)],
        *([f"_p{k}" for k in range(n)] if presence else []),
    )


DEVICE, ACQUISITION = "_device", "_acquisition"


def _acquisition_pair() -> Column:
    return F.struct(
        F.coalesce(F.col("traffic_source.source"), F.lit(DIRECT_SOURCE)).alias("first_user_source"),
        F.coalesce(F.col("traffic_source.medium"), F.lit(NONE_MEDIUM)).alias("first_user_medium"),
    )


def session_frame(
    source: SourceLike,
    period: Period | None = OFFICIAL_PERIOD,
    stages: Sequence[str] = CORE_STAGES,
) -> DataFrame:
    """What 06, 07, 08, 10 and C1 need of every session, in one frame.

    Pass it (stored) to those operators as ``sessions`` to scan the events
    once for all of them.
    """
    attributes = {DEVICE: (F.col("device.category"), True), ACQUISITION: (_acquisition_pair(), False)}
    return ordered_stage_times(
        source, period, stages, attributes, require_user=False, presence=True
    )


def _times(
    source: SourceLike,
    period: Period | None,
    stages: Sequence[str],
    sessions: DataFrame | None,
    attributes: dict[str, tuple[Column, bool]] | None = None,
) -> DataFrame:
    if sessions is not None:
        return sessions.where(F.col(USER).isNotNull())
    return ordered_stage_times(source, period, stages, attributes)


def _stage_counts(times: DataFrame, n: int, dims: Sequence[str]) -> DataFrame:
    """Sessions per stage (and per ``dims``): ``_n0 .. _n{n-1}``."""
    aggs = [F.expr(f"count(_t{k}) AS _n{k}") for k in range(n)]
    return times.groupBy(*dims).agg(*aggs) if dims else times.agg(*aggs)


_HUNDRED = "CAST(100 AS DOUBLE)"


def _step_rows(counts: DataFrame, labels: Sequence[str], first_stage: str) -> DataFrame:
    """05 / 10 report: one row per stage."""
    rows = []
    for k, label in enumerate(labels):
        rows.append(
            [
                ("step_number", f"{k + 1}"),
                ("funnel_step", text_sql(label)),
                ("sessions", f"_n{k}"),
                ("conversion_from_previous_step_pct", pct_sql(f"_n{k}", f"_n{k - 1}") if k else _HUNDRED),
                (f"conversion_from_{first_stage}_pct", pct_sql(f"_n{k}", "_n0") if k else _HUNDRED),
            ]
        )
    return rows_from_one(counts, rows)


def ordered_funnel(
    source: SourceLike,
    period: Period | None = OFFICIAL_PERIOD,
    stages: Sequence[str] = CORE_STAGES,
    labels: Sequence[str] | None = None,
    sessions: DataFrame | None = None,
) -> DataFrame:
    """Statement 10: ordered session funnel, one row per stage."""
    labels = _check_stages(stages, labels)
    times = _times(source, period, stages, sessions)
    counts = _stage_counts(times, len(stages), [])
    return _step_rows(counts, labels, stages[0]).orderBy("step_number")


def funnel_dropoff(
    source: SourceLike,
    period: Period | None = OFFICIAL_PERIOD,
    stages: Sequence[str] = CORE_STAGES,
    labels: Sequence[str] | None = None,
    sessions: DataFrame | None = None,
) -> DataFrame:
    """Statement 06: sessions lost between consecutive ordered stages."""
    labels = _check_stages(stages, labels)
    times = _times(source, period, stages, sessions)
    counts = _stage_counts(times, len(stages), [])
    rows = []
    for k in range(len(stages) - 1):
        start, cont = f"_n{k}", f"_n{k + 1}"
        rows.append(
            [
                ("transition_number", f"{k + 1}"),
                ("funnel_transition", text_sql(f"{labels[k]} -> {labels[k + 1]}")),
                ("starting_sessions", start),
                ("continuing_sessions", cont),
                ("dropped_sessions", f"{start} - {cont}"),
                ("dropoff_rate_pct", pct_sql(f"({start} - {cont})", start)),
            ]
        )
    return rows_from_one(counts, rows).orderBy("transition_number")


def _rate_names(stages: Sequence[str]) -> list[str]:
    if list(stages) == list(CORE_STAGES):
        # fixed values: the reference's rate column names for the core funnel
        return [
            "view_to_cart_rate_pct",
            "cart_to_checkout_rate_pct",
            "checkout_to_purchase_rate_pct",
            "overall_purchase_rate_pct",
        ]
    pairs = [f"{a}_to_{b}_rate_pct" for a, b in zip(stages, stages[1:])]
    return pairs + [f"overall_{stages[-1]}_rate_pct"]


def _segment_columns(stages: Sequence[str]) -> list[Column]:
    names = _rate_names(stages)
    cols = [f"_n{k} AS `{s}_sessions`" for k, s in enumerate(stages)]
    cols += [f"{pct_sql(f'_n{k + 1}', f'_n{k}')} AS `{names[k]}`" for k in range(len(stages) - 1)]
    cols.append(f"{pct_sql(f'_n{len(stages) - 1}', '_n0')} AS `{names[-1]}`")
    return [F.expr(c) for c in cols]


def funnel_by_segment(
    source: SourceLike,
    period: Period | None,
    segment: Column,
    *,
    name: str = "segment",
    ignore_nulls: bool = True,
    null_label: str | None = None,
    stages: Sequence[str] = CORE_STAGES,
    min_sessions: int = 0,
    top: int | None = None,
    sessions: DataFrame | None = None,
    session_column: str = "_segment",
) -> DataFrame:
    """Ordered funnel per session segment.

    A session's segment is the value of ``segment`` on its earliest stage-0
    event (the earliest non-null one with ``ignore_nulls``; ties: the smallest
    value). A struct segment yields one output column per field; a scalar one
    the column ``name``, with nulls shown as ``null_label`` *after* grouping
    (so a null and a literal label stay separate rows). Groups with fewer than
    ``min_sessions`` stage-0 sessions are dropped; the ``top`` largest are
    returned (ties: segment columns ascending).
    """
    _check_stages(stages, None)
    seg = "_segment" if sessions is None else session_column
    times = _times(source, period, stages, sessions, {seg: (segment, ignore_nulls)})
    counts = _stage_counts(times, len(stages), [seg])
    seg_type = counts.schema[seg].dataType
    if isinstance(seg_type, StructType):
        seg_cols = [F.col(seg)[f.name].alias(f.name) for f in seg_type.fields]
        names = [f.name for f in seg_type.fields]
    else:
        value = F.col(seg) if null_label is None else F.coalesce(F.col(seg), F.lit(null_label))
        seg_cols, names = [value.alias(name)], [name]
    out = counts.select(*seg_cols, *_segment_columns(stages))
    if min_sessions > 0:
        out = out.where(F.col(f"{stages[0]}_sessions") >= min_sessions)
    out = out.orderBy(F.col(f"{stages[0]}_sessions").desc(), *names)
    return out.limit(top) if top is not None else out


def funnel_by_device(
    source: SourceLike,
    period: Period | None = OFFICIAL_PERIOD,
    stages: Sequence[str] = CORE_STAGES,
    sessions: DataFrame | None = None,
) -> DataFrame:
    """Statement 07: ordered funnel per device category.

    A session's device is the first **non-null** ``device.category`` among its
    stage-0 events by time (the SQL's rule; its header says "recorded on the
    first product view"). Grouping is on the raw value and the label
    ``unknown`` is applied after, so a null device and a literal ``unknown``
    stay two rows, as in the reference.
    """
    return funnel_by_segment(
        source,
        period,
        F.col("device.category"),
        name="device_category",
        ignore_nulls=True,
        null_label=UNKNOWN_DEVICE,
        stages=stages,
        sessions=sessions,
        session_column=DEVICE,
    )


def funnel_by_first_source(
    source: SourceLike,
    period: Period | None = OFFICIAL_PERIOD,
    stages: Sequence[str] = CORE_STAGES,
    min_sessions: int = 100,
    top: int | None = 15,
    sessions: DataFrame | None = None,
) -> DataFrame:
    """Statement 08: ordered funnel per first-user (source, medium).

    Null source / medium become ``(direct)`` / ``(none)`` per event; the pair
    is taken from one row, the session's earliest stage-0 event (ties: the
    smallest pair). Groups with fewer than ``min_sessions`` stage-0 sessions
    are dropped; the ``top`` largest are returned (ties: source, medium).
    """
    return funnel_by_segment(
        source,
        period,
        _acquisition_pair(),
        ignore_nulls=False,
        stages=stages,
        min_sessions=min_sessions,
        top=top,
        sessions=sessions,
        session_column=ACQUISITION,
    )


def presence_counts(
    source: SourceLike,
    period: Period | None = OFFICIAL_PERIOD,
    stages: Sequence[str] = CORE_STAGES,
) -> DataFrame:
    """One row ``_n0.._n{k}``: sessions having stages 0..k anywhere.

    Sessions need a session id; a null user is kept as its own group (the
    reference filters only the session id here).
    """
    ev = as_source(source).scan(period, stages).select(
        F.col(USER), session_id().alias(SESSION), F.col("event_name")
    )
    flags = [F.bool_or(F.col("event_name") == s).alias(f"_has{k}") for k, s in enumerate(stages)]
    per_session = ev.where(F.col(SESSION).isNotNull()).groupBy(*KEYS).agg(*flags)
    aggs = []
    for k in range(len(stages)):
        cond = reduce(lambda a, b: a & b, [F.col(f"_has{i}") for i in range(k + 1)])
        aggs.append(F.count_if(cond).alias(f"_n{k}"))
    return per_session.agg(*aggs)


def presence_funnel(
    source: SourceLike,
    period: Period | None = OFFICIAL_PERIOD,
    stages: Sequence[str] = CORE_STAGES,
    labels: Sequence[str] | None = None,
) -> DataFrame:
    """Statement 05: a session reaches stage k if stages 0..k all occur in it."""
    labels = _check_stages(stages, labels)
    counts = presence_counts(source, period, stages)
    return _step_rows(counts, labels, stages[0]).orderBy("step_number")


def presence_vs_ordered(
    source: SourceLike,
    period: Period | None = OFFICIAL_PERIOD,
    stages: Sequence[str] = CORE_STAGES,
    labels: Sequence[str] | None = None,
    sessions: DataFrame | None = None,
) -> DataFrame:
    """C1: presence and ordered sessions per stage and the sessions excluded by
    the ordering rule, with both conversion rates from the first stage.

    Both funnels come from one per-session frame (one scan): presence counts sessions with a session id whatever the user,
    the ordered funnel only sessions with a user, as statements 05 and 10 do.
    """
    labels = _check_stages(stages, labels)
    n = len(stages)
    times = sessions
    if times is None:
        times = ordered_stage_times(source, period, stages, require_user=False, presence=True)
    aggs = []
    for k in range(n):
        aggs.append(f"count_if({' AND '.join(f'_p{i}' for i in range(k + 1))}) AS _pres{k}")
        aggs.append(f"count_if({USER} IS NOT NULL AND _t{k} IS NOT NULL) AS _ord{k}")
    counts = times.agg(*map(F.expr, aggs))
    rows = []
    for k, label in enumerate(labels):
        p, o = f"_pres{k}", f"_ord{k}"
        rows.append(
            [
                ("step_number", f"{k + 1}"),
                ("funnel_step", text_sql(label)),
                ("presence_sessions", p),
                ("ordered_sessions", o),
                ("sessions_excluded_by_ordering", f"{p} - {o}"),
                ("presence_conversion_pct", pct_sql(p, "_pres0") if k else _HUNDRED),
                ("ordered_conversion_pct", pct_sql(o, "_ord0") if k else _HUNDRED),
            ]
        )
    return rows_from_one(counts, rows).orderBy("step_number")
