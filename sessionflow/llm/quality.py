"""Quality classifier: regularised quadratic discriminant over text statistics.

Each whole text becomes a vector of transformed statistics (logs of sizes,
log ratios of character, word, line and repetition counts). Per class a mean
and a covariance are fitted; the covariance is shrunk toward the pooled one
and toward its own diagonal. A score is the class posterior from the
difference of the Mahalanobis log densities, through Cholesky factors that
are computed once when the model is made.

Semantics: a null text is empty and gets a score like any other. The label
of a row is looked up by its id; rows with null ids have none. If no label,
or only one class, is available, every score is the share of label 1 (0.5
without labels). Repeated rows are scored alike. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import least_by_hash

#: Most labelled rows the model is fitted on, taken in hash order of the id.
FIT_ROWS = 20_000
_CLASS_OF_BYTE = np.full(256, 8, np.int64)
for _cls, _bytes in enumerate(
    [range(97, 123), range(65, 91), range(48, 58), b" \t\r", b"\n", b".,;:'\"-()", b"!?", b"|#$%&*=<>{}[]\\/_~^+@"]
):
    for _b in _bytes:
        _CLASS_OF_BYTE[_b] = _cls
_CLASS_OF_BYTE[128:] = 9
N_FEATURES = 19
_JUNK_TAIL = re.compile(r"[^\w\s.,;:'\"()-]")


def features(text: str | None) -> np.ndarray:
    """Transformed statistics of one whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode(), np.uint8)
    by_class = np.zeros(10)
    np.add.at(by_class, _CLASS_OF_BYTE, np.bincount(raw, minlength=256))
    n = len(raw)
    words = text.split()
    m = len(words)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) if m > 1 else 0  # noqa: B905  one shorter
    lengths = np.fromiter(map(len, words), np.float64, m)
    lines = [x for x in text.split("\n") if x]
    marked = sum(c for w, c in counts.items() if _JUNK_TAIL.search(w))
    upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())

    def log_ratio(part: float, whole: float, usual: float, strength: float = 40.0) -> float:
        """Log share, drawn toward the ``usual`` one where there is little text."""
        return float(np.log((part + strength * usual) / (whole + strength)))

    return np.array(
        [
            np.log(n + 200.0),
            np.log(m + 40.0),
            log_ratio(by_class[1], n, 0.02),
            log_ratio(by_class[2], n, 0.005),
            log_ratio(by_class[3], n, 0.15),
            log_ratio(by_class[4], n, 0.005),
            log_ratio(by_class[5], n, 0.03),
            log_ratio(by_class[6], n, 0.005),
            log_ratio(by_class[7], n, 0.005),
            log_ratio(by_class[9], n, 0.05),
            float((lengths.sum() + 40 * 5.0) / (m + 40)),
            float(np.sqrt((((lengths - 5.0) ** 2).sum() + 40 * 9.0) / (m + 40))),
            log_ratio(len(counts), m, 0.8),
            log_ratio(max(counts.values(), default=0), m, 0.05),
            log_ratio(pairs, max(m - 1, 0), 1.0),
            log_ratio(len(set(lines)), len(lines), 1.0, 4.0),
            log_ratio(marked, m, 0.01),
            log_ratio(upper, m, 0.01),
            log_ratio(max(map(len, lines), default=0), n, 0.5, 400.0),
        ]
    )


@dataclass
class Discriminant:
    """Class means and Cholesky factors of the shrunk covariances."""

    means: np.ndarray  # (2, features)
    factors: np.ndarray  # (2, features, features), lower triangular inverses
    offset: np.ndarray  # (2,) log prior minus half the log determinant
    share: float  # of label 1, the score where there is no model

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, shrink: float = 0.1, diagonal: float = 0.05):
        """``shrink`` moves a class covariance toward the pooled one and
        ``diagonal`` toward its own diagonal."""
        share = float(y.mean()) if len(y) else 0.5
        if len(np.unique(y)) < 2:
            return cls(np.zeros((2, 0)), np.zeros((2, 0, 0)), np.zeros(2), share)
        d = x.shape[1]
        spread = x.var(0).mean() * 1e-3 + 1e-6
        groups = [x[y == c] for c in (0, 1)]
        means = np.stack([g.mean(0) for g in groups])
        scatter = [(g - mu).T @ (g - mu) for g, mu in zip(groups, means, strict=True)]
        pooled = sum(scatter) / len(x)
        factors, offset = [], []
        for g, s in zip(groups, scatter, strict=True):
            keep = (1 - shrink) * len(g) / (len(g) + d)
            cov = keep * s / len(g) + (1 - keep) * pooled
            cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + spread * np.eye(d)
            low = np.linalg.cholesky(cov)
            factors.append(np.linalg.inv(low))
            offset.append(np.log(len(g) / len(x)) - np.log(np.diag(low)).sum())
        return cls(means, np.stack(factors), np.array(offset), share)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior of label 1 per row of ``x``."""
        if not self.means.shape[1]:
            return np.full(len(x), self.share)
        log_density = [
            o - 0.5 * (((x - mu) @ f.T) ** 2).sum(1)
            for mu, f, o in zip(self.means, self.factors, self.offset, strict=True)
        ]
        gap = np.clip(log_density[1] - log_density[0], -60, 60)
        return 1 / (1 + np.exp(-gap))


def labelled_ids(labels: DataFrame, label: str, held_out: Column) -> DataFrame:
    """(doc_id, y) of every labelled id that is not held out; ids that the labels
    give twice with different values have no label."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("_y"))
        .where("y = _y")
        .where(~held_out)
        .select("doc_id", "y")
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, held_out: Column, limit: int
) -> DataFrame:
    """(text, y) of at most ``limit`` labelled rows that are not held out.

    The rows of least hash of the id are taken.
    """
    ids = labelled_ids(labels, label, held_out).withColumn("_hash", F.xxhash64("doc_id"))
    ids = least_by_hash(ids, "_hash", limit, "doc_id").select("doc_id", "y")
    # at most ``limit`` pairs of numbers: a bounded broadcast
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(ids), "doc_id"
    )


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, limit: int = FIT_ROWS) -> Discriminant:
    """Fit on at most ``limit`` labelled rows; their statistics reach the driver."""
    sample = labelled_sample(docs, labels, "quality", held_out, limit)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(
                {"doc_id": part["doc_id"], "y": part["y"], "x": [features(t).tolist() for t in part["text"]]}
            )

    rows = sample.mapInPandas(run, "doc_id long, y int, x array<double>")
    # a repeated id would count twice, so one row of each stays
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).select("doc_id", "r.*")
    rows = rows.orderBy("doc_id").toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, N_FEATURES)
    return Discriminant.fit(x, rows["y"].to_numpy(np.int64))


def score(model: Discriminant, text: Column) -> Column:
    """Score between 0 and 1 of a text column; higher: label 1 likelier."""

    @F.pandas_udf(T.DoubleType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            x = [features(t) for t in part]
            yield pd.Series(model.scores(np.array(x).reshape(-1, N_FEATURES)), index=part.index)

    return run(text)
