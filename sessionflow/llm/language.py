"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior per text: the likelihood of its
character trigrams under each language, the language that its markup
declares, the suffix of its address, and its host. Languages and their
trigram counts come from all labelled texts, by grouped aggregation. How
reliable a declaration is, and what a host usually holds, is counted over all
rows by their text alone: the prior of a host is smoothed toward its domain,
the domain toward the suffix, the suffix toward all rows; each row leaves its
own count out. Unknown evidence (no declaration, no host) says nothing.

Semantics: a null or empty text has no likelihood, so the other evidence
decides. Ties go to the first language by name. Without labelled texts the
language is null with confidence 0. Repeated rows count as often as they
occur. Only the named columns are read.
"""

from __future__ import annotations

import html as html_lib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import salted_join, slices, staged
from .toxicity import SYMBOLS, _codes

#: Trigrams of evidence at which a text's likelihood stops growing.
EFFECTIVE_TRIGRAMS = 60
#: Weight, in rows, of the coarser level in a smoothed count.
SMOOTHING = 4.0
LEVELS = ("suffix", "domain", "host")


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram numbers of all texts, where each text's begin)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    c = _codes("  " + "  ".join(texts) + "  ")
    grams = (c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:]
    return grams, np.cumsum(lengths) - lengths


def language_counts(texts: DataFrame) -> dict[str, np.ndarray]:
    """Trigram counts per language over all rows (lang, text).

    A language has a fixed number of counts, whatever the input's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            at = 0
            for part in slices(batch.column(1).to_pylist()):
                grams, starts = _trigrams(part)
                ends = np.append(starts[1:], len(grams))
                names = np.array(langs[at : at + len(part)])
                at += len(part)
                for lang in set(names.tolist()):
                    own = np.zeros(len(grams) + 1, np.int64)
                    np.add.at(own, starts[names == lang], 1)
                    np.add.at(own, ends[names == lang], -1)
                    seen = grams[np.cumsum(own[:-1]) > 0]
                    totals.setdefault(lang, np.zeros(SYMBOLS**3, np.int64))
                    totals[lang] += np.bincount(seen, minlength=SYMBOLS**3)
        for lang, total in totals.items():
            found = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found)), pa.array(found), pa.array(total[found])],
                ["lang", "gram", "n"],
            )

    rows = (
        texts.select(F.col("lang"), F.coalesce("text", F.lit("")).alias("text"))
        .where("lang is not null")
        .mapInArrow(run, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    )
    counts = {}
    for lang, part in rows.groupby("lang"):
        counts[str(lang)] = np.zeros(SYMBOLS**3)
        counts[str(lang)][part["gram"].to_numpy(np.int64)] = part["n"].to_numpy(np.float64)
    return dict(sorted(counts.items()))


def _log_table(counts: dict[str, np.ndarray]) -> np.ndarray:
    """(trigrams, languages): log probability of the last sign given the two before."""
    out = []
    for c in counts.values():
        tri = c.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        uni = tri.sum((0, 1)) + 1.0
        bi = tri.sum(0)
        p1 = uni / uni.sum()
        p2 = (bi + 10 * p1) / (bi.sum(1, keepdims=True) + 10)
        out.append(np.log((tri + 10 * p2[None]) / (tri.sum(2, keepdims=True) + 10)).ravel())
    return np.stack(out, 1).astype(np.float32)


def text_evidence(rows: DataFrame, counts: dict[str, np.ndarray], text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``loglik``: one tempered log likelihood per language."""
    table = _log_table(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in slices(batch.column(0).to_pylist()):
                grams, starts = _trigrams(part)
                sums = np.add.reduceat(table[grams], starts, axis=0, dtype=np.float64)
                n = np.diff(np.append(starts, len(grams)))
                empty = np.fromiter(map(len, part), np.int64, len(part)) == 0
                sums *= (np.minimum(n, EFFECTIVE_TRIGRAMS) / n * ~empty)[:, None]
                found += sums.tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(found, pa.list_(pa.float64()))], [*keep, "loglik"]
            )

    kept = rows.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    return kept.mapInArrow(run, f"{schema}, loglik array<double>")


# Second labels that countries give out names under, as in co.uk.
_SHARED = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "ne", "net", "or", "org")


def address(url: Column) -> list[Column]:
    """host, domain and suffix of an address; null where there is none.

    The domain is the last two labels, or three where a country's second label
    is shared by all (``co.uk``).
    """
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    shared = host.rlike(rf"\.(?:{'|'.join(_SHARED)})\.[a-z]{{2}}$")
    return [
        host.alias("host"),
        F.when(shared, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2)).alias("domain"),
        F.substring_index(host, ".", -1).alias("suffix"),
    ]


def declared_language(html: Column) -> Column:
    """Primary tag of the language that a page's markup declares, or null."""
    page = F.coalesce(html, F.lit(""))
    tag = F.regexp_extract(page, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})", 1)
    # the attributes of a meta element stand in any order
    meta = F.regexp_extract(
        page, r"(?is)<meta\b(?=[^>]*content-language)[^>]*?\bcontent\s*=\s*[\"']?\s*([a-z]{2,3})", 1
    )
    found = F.lower(F.when(tag != "", tag).otherwise(meta))
    return F.when(found != "", found)


@F.pandas_udf(T.StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    return texts.map(html_lib.unescape)


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags, character
    references decoded."""
    page = F.coalesce(html, F.lit(""))
    page = F.regexp_replace(page, r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)", " ")
    return _decoded(F.regexp_replace(page, r"<[^>]*>", " "))


def identify(rows: DataFrame, labelled: DataFrame, keep: list[str]) -> DataFrame:
    """Language per row of ``rows`` (text, declared, host, domain, suffix and ``keep``).

    ``labelled`` has the columns lang and text. Adds lang, confidence and
    text_lang, the choice by text alone.
    """
    counts = language_counts(labelled)
    langs = list(counts)
    if not langs:
        none = F.lit(None).cast("string")
        return rows.select(*keep, none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"))
    known = ["declared", *LEVELS]
    seen = staged(text_evidence(rows, counts, "text", [*keep, *known]), "language-evidence")
    # one struct per language: the largest carries its place and name (ties: the first name)
    by_text = [
        F.struct(F.col("loglik")[i].alias("score"), F.lit(-i).alias("place"), F.lit(langs[i]).alias("lang"))
        for i in range(len(langs))
    ]
    has_text = F.exists("loglik", lambda v: v != 0)
    seen = seen.withColumn("_text", F.when(has_text, F.array_max(F.array(*by_text))))
    seen = seen.withColumn("_guess", -F.col("_text.place"))
    hits = [F.count(F.when(F.col("_guess") == i, 1)).cast("double") for i in range(len(langs))]

    def counted(by: list[str], name: str) -> DataFrame:
        return seen.where(F.col(by[-1]).isNotNull()).groupBy(*by).agg(F.array(*hits).alias(name))

    total = seen.agg(*[h.alias(f"n{i}") for i, h in enumerate(hits)]).first()
    total = [float(total[i]) for i in range(len(langs))]
    evidence = seen
    for level in LEVELS:
        evidence = salted_join(evidence, counted([level], f"_{level}"), [level], keep, "left")
    evidence = salted_join(evidence, counted(["declared"], "_declared"), ["declared"], keep, "left")
    own = [F.when(F.col("_guess") == i, 1.0).otherwise(0.0) for i in range(len(langs))]
    prior = [(F.lit(n) - o + 1.0) / F.lit(sum(total) + len(langs)) for n, o in zip(total, own, strict=True)]
    for level in LEVELS:
        # a row without this level, or alone in it, keeps the coarser prior
        n = [F.coalesce(F.col(f"_{level}")[i], F.lit(0.0)) - F.when(F.col(f"_{level}").isNotNull(), own[i]).otherwise(0.0) for i in range(len(langs))]
        size = sum(n[1:], n[0])
        evidence = evidence.select(
            "*", *[((n[i] + SMOOTHING * prior[i]) / (size + SMOOTHING)).alias(f"_{level}{i}") for i in range(len(langs))]
        )
        prior = [F.col(f"_{level}{i}") for i in range(len(langs))]
    # P(declared | language): how often rows of a language by text declare this one
    said = [F.coalesce(F.col("_declared")[i] - own[i], F.lit(0.0)) for i in range(len(langs))]
    trust = [
        F.when(F.col("declared").isNull(), F.lit(0.0)).otherwise(
            F.log((said[i] + F.when(F.col("declared") == langs[i], 2.0).otherwise(0.2)) / (total[i] + SMOOTHING))
        )
        for i in range(len(langs))
    ]
    scores = [F.col("loglik")[i] + F.log(prior[i]) + trust[i] for i in range(len(langs))]
    ranked = [
        F.struct(v.alias("score"), F.lit(-i).alias("place"), F.lit(langs[i]).alias("lang"))
        for i, v in enumerate(scores)
    ]
    evidence = evidence.withColumn("_ranked", F.array(*ranked)).withColumn("_top", F.array_max("_ranked"))
    share = F.aggregate(
        "_ranked", F.lit(0.0), lambda a, v: a + F.exp(v["score"] - F.col("_top.score"))
    )
    return evidence.select(
        *keep,
        F.col("_top.lang").alias("lang"),
        F.least(F.lit(1.0), 1 / share).alias("confidence"),
        F.col("_text.lang").alias("text_lang"),
    )


def identify_corpus(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Languages of all documents and all pages, fused over both tables.

    A document has no markup and no address; its source stands for the host.
    """
    none = F.lit(None).cast("string")
    docs = documents.select(
        F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"),
        F.lit(None).cast("long").alias("page_id"), "text", none.alias("declared"),
        F.col("source").cast("string").alias("host"), none.alias("domain"), none.alias("suffix"),
    )
    web = pages.select(
        F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"),
        F.col("page_id").cast("long").alias("page_id"), visible_text(F.col("html")).alias("text"),
        declared_language(F.col("html")).alias("declared"), *address(F.col("url")),
    )
    labelled = documents.select(F.col("lang").cast("string").alias("lang"), "text")
    return identify(docs.unionByName(web), labelled, ["kind", "doc_id", "page_id"])
