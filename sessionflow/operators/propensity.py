"""Purchase propensity: point-in-time features, a model and its ranking metrics.

A row is a user at a cutoff day. Its features come from the events of the
``lookback`` days before the cutoff, its label from the ``horizon`` days from
the cutoff on (a purchase event). Nothing after the cutoff's midnight enters a
feature. Users without an event in the lookback have no row, nor have events
without a user.

Features are sums, so they are computed without an as-of join: events collapse
to one row per (user, day) before the shuffle; a day then counts for the few
cutoffs whose windows hold it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import event_day, safe_div
from ..plans.staging import staged
from ..schema import CORE_STAGES, Period
from ..sources.base import SourceLike, as_source

USER = "user_pseudo_id"


@dataclass(frozen=True)
class Cutoffs:
    """Prediction days and the days before and from them that count."""

    days: tuple[dt.date, ...]
    lookback: int = 7
    horizon: int = 7

    def period(self) -> Period:
        """All days that any cutoff reads."""
        first = min(self.days) - dt.timedelta(self.lookback)
        last = max(self.days) + dt.timedelta(self.horizon - 1)
        return Period(first.strftime("%Y%m%d"), last.strftime("%Y%m%d"))


def feature_names(stages: Sequence[str] = CORE_STAGES) -> list[str]:
    return [*[f"{s}_events" for s in stages], "events", "active_days", "days_since_last_event"]


def propensity_features(
    source: SourceLike, cutoffs: Cutoffs, stages: Sequence[str] = CORE_STAGES
) -> DataFrame:
    """(user, cutoff, features, label) per user and cutoff.

    ``stages[-1]`` is the event to be predicted.
    """
    if not cutoffs.days or min(cutoffs.lookback, cutoffs.horizon) < 1:
        raise ValueError("cutoffs need at least one day, a lookback and a horizon")
    name = F.col("event_name")
    daily = (
        as_source(source).scan(cutoffs.period())
        .where(F.col(USER).isNotNull())
        .groupBy(USER, "event_date")
        .agg(*[F.count_if(name == s).alias(f"_n{k}") for k, s in enumerate(stages)], F.count(F.lit(1)).alias("_n"))
        .withColumn("_day", event_day())
    )
    days = F.array(*[F.lit(d) for d in sorted(cutoffs.days)])
    day = F.col("_day")

    def counts_for(cutoff: Column) -> Column:
        return (day >= F.date_sub(cutoff, cutoffs.lookback)) & (day < F.date_add(cutoff, cutoffs.horizon))

    spread = daily.withColumn("cutoff", F.explode(F.filter(days, counts_for)))
    before = day < F.col("cutoff")

    def past(value: Column | str) -> Column:
        return F.coalesce(F.sum(F.when(before, F.col(value) if isinstance(value, str) else value)), F.lit(0)).cast("long")

    last = len(stages) - 1
    rows = spread.groupBy(USER, "cutoff").agg(
        *[past(f"_n{k}").alias(f"{s}_events") for k, s in enumerate(stages)],
        past("_n").alias("events"),
        past(F.lit(1)).alias("active_days"),
        F.date_diff(F.col("cutoff"), F.max(F.when(before, day))).cast("long").alias("days_since_last_event"),
        (F.coalesce(F.sum(F.when(~before, F.col(f"_n{last}"))), F.lit(0)) > 0).cast("int").alias("label"),
    )
    return rows.where(F.col("active_days") > 0)


def fit_propensity(train: DataFrame, names: Sequence[str], regularisation: float = 0.01) -> PipelineModel:
    """Scaled logistic regression on the feature columns ``names``.

    Spark fits it by distributed gradient sums; rows stay on the executors.
    """
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(names), outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
            LogisticRegression(featuresCol="_scaled", labelCol="label", regParam=regularisation, maxIter=50),
        ]
    ).fit(train)


def score_propensity(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(user, cutoff, score, label): the modelled probability of a purchase."""
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select(USER, "cutoff", "score", "label")


def held_out_scores(
    source: SourceLike, cutoffs: Cutoffs, stages: Sequence[str] = CORE_STAGES
) -> DataFrame:
    """Scores at the last cutoff by a model of the cutoffs known by then.

    A cutoff is used for training only if its horizon ends by the last cutoff,
    so no label of the training rows lies in the held-out period.
    """
    last = max(cutoffs.days)
    known = [d for d in cutoffs.days if d + dt.timedelta(cutoffs.horizon) <= last]
    if not known:
        raise ValueError("no cutoff's horizon ends by the last cutoff")
    rows = staged(propensity_features(source, cutoffs, stages), "propensity")
    model = fit_propensity(rows.where(F.col("cutoff").isin(known)), feature_names(stages))
    return score_propensity(model, rows.where(F.col("cutoff") == F.lit(last)))


def rule_score(stages: Sequence[str] = CORE_STAGES) -> Column:
    """A score without a model: later stages weigh more, days without events less."""
    weighed = [F.col(f"{s}_events") * (2**k) for k, s in enumerate(stages)]
    total = weighed[0]
    for w in weighed[1:]:
        total = total + w
    return (total - F.col("days_since_last_event")).cast("double")


def _tie_groups(scored: DataFrame) -> tuple[DataFrame, int, int]:
    """(score, rows, positives, rows above, positives above), greatest score first.

    Equal scores are one group before they are sorted. The groups are sorted
    over all tasks and written once; partitions report their sums, and each
    is moved by the sums of those before it. No window spans the table.
    """
    groups = scored.where(F.col("score").isNotNull() & F.col("label").isNotNull()).groupBy("score").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("p")
    )
    held = staged(
        groups.orderBy(F.desc("score")).withColumn("part", F.spark_partition_id()), "score-groups"
    )
    parts = held.groupBy("part").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).orderBy("part").collect()
    before, rows, positives = [], 0, 0
    for r in parts:  # a row per partition of the sort
        before.append((r["part"], rows, positives))
        rows, positives = rows + r["n"], positives + r["p"]
    spark = scored.sparkSession
    offsets = spark.createDataFrame(before, "part int, _rows long, _positives long")
    inside = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    moved = held.join(F.broadcast(offsets), "part").select(
        "score",
        "n",
        "p",
        (F.col("_rows") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("rows_above"),
        (F.col("_positives") + F.coalesce(F.sum("p").over(inside), F.lit(0))).alias("positives_above"),
    )
    return moved, rows, positives


def ranking_metrics(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Lift per score bin, with the area under the ROC curve on every row.

    ``scored`` has (score, label 0 / 1); rows with a null in either do not
    count. Rows of one score are never parted: a group belongs to the bin of
    its first row in descending order. The area counts a pair of a positive
    and a negative of equal score as half, exactly, in whole numbers; it is
    null unless both labels occur. Bins that no group begins in have no row.
    """
    groups, total, positives = _tie_groups(scored)
    n, p = F.col("n"), F.col("p")
    # twice the pairs won: negatives against the positives above them and beside
    won = (n - p).cast("decimal(19,0)") * (2 * F.col("positives_above") + p).cast("decimal(19,0)")
    number = F.expr(f"cast(rows_above * {int(bins)} div {max(total, 1)} + 1 as int)")
    binned = groups.withColumns({"bin": number, "_won": won})
    per_bin = binned.groupBy("bin").agg(
        F.sum("n").alias("rows"),
        F.sum("p").alias("positives"),
        F.max("score").alias("highest_score"),
        F.min("score").alias("lowest_score"),
        F.sum("_won").alias("_won"),
    )
    pairs = 2 * positives * (total - positives)
    every = Window.partitionBy()  # ``bins`` rows
    area = F.round(safe_div(F.sum("_won").over(every), F.lit(float(pairs))), 6)
    rate = safe_div(F.col("positives"), F.col("rows"))
    return per_bin.select(
        "bin",
        "rows",
        "positives",
        "highest_score",
        "lowest_score",
        F.round(rate, 6).alias("positive_rate"),
        F.round(safe_div(rate, safe_div(F.lit(positives), F.lit(total))), 6).alias("lift"),
        area.alias("area_under_curve"),
    ).orderBy("bin")
