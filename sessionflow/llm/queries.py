"""The registered queries: each operator over its whole table."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    clusters,
    fill_middle,
    html_text,
    language,
    packing,
    pii,
    quality,
    sharding,
    simhash,
    spotsigs,
    toxicity,
    vectors,
)
from .common import held_out, table

#: Per application, the folder of the archive sent to its executors.
_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Their Python workers import the operators; on a cluster they have no copy
    of the repository. The driver's archive is deleted when the driver ends.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    _SHIPPED[app] = tempfile.TemporaryDirectory(prefix=f"{package.name}-")
    tmp = _SHIPPED[app].name
    shutil.copytree(
        package, os.path.join(tmp, "src", package.name), ignore=shutil.ignore_patterns("__pycache__")
    )
    archive = shutil.make_archive(os.path.join(tmp, package.name), "zip", os.path.join(tmp, "src"))
    spark.sparkContext.addPyFile(archive)


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file, the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), 2048, end_id=0)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def _scored(docs: DataFrame, held: Column, score: Column) -> DataFrame:
    scored = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), score.alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"), 5, 0)
    scored = toxicity.scored(docs, table(spark, sf_dir, "labels"), held, keep=["doc_id"])
    return _scored(scored, held, F.col("score"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_corpus(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pii.fit(docs)
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), pii.find(model, F.col("text")).alias("found")
    )

    def joined(spans: str) -> Column:
        return F.array_join(
            F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
        )

    def count(kind: str) -> Column:
        return F.size(F.filter(F.col("found.base"), lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(joined("found.base"), 256).alias("base_sha256"),
        joined("found.spans").alias("spans"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_digests(
        table(spark, sf_dir, "documents"),
        tokenizer_file("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"), 3, 1)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), held)
    return _scored(docs, held, quality.score(model, F.col("text")))


#: Shards of equal weight, and the weight of the one that may be added.
SHARDS = 16


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS, 1.0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = fill_middle.fill_middle(docs)
    return done.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64.0)


_QUERIES = [
    op1_best_fit_packing,
    op2_document_fingerprints,
    op3_embedding_near_dedup,
    op4_html_extraction,
    op5_simhash_near_dedup,
    op6_toxicity,
    op7_language_id,
    op8_pii,
    op9_byte_bpe,
    op10_quality,
    op11_sharding,
    op12_fill_in_middle,
    op13_centroid_clustering,
]


def _shipped(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: _shipped(query) for query in _QUERIES}


def _fill_in_middle_sql() -> str:
    group = "CAST('0x' || substr(digest, {}, 8) AS UBIGINT)"
    h1, h2, h3, h4 = (group.format(8 * i + 1) for i in range(4))
    return f"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS whole, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
  FROM documents
), cut AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n,
         CAST(least({h1} % (len(units) + 1), {h2} % (len(units) + 1)) AS BIGINT) AS a,
         CAST(greatest({h1} % (len(units) + 1), {h2} % (len(units) + 1)) AS BIGINT) AS b,
         CASE WHEN whole = '' OR contains(whole, '<P>') OR contains(whole, '<S>') OR contains(whole, '<M>')
                   OR {h3} % 100 >= 90 THEN 'plain'
              WHEN {h4} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix,
         coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
  FROM cut
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN whole
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM parts"""


def _centroid_clustering_sql(rounds: int = 3) -> str:
    ctes = [
        """kept AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        """ranked AS (
  SELECT v, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c FROM kept
)""",
        "c0 AS (SELECT c, v AS m FROM ranked WHERE c < 16)",
    ]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min((d, c)) AS best
  FROM (SELECT r, vec_id, v, c,
               CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
        FROM kept, c{i})
  GROUP BY r
)""")
        ctes.append(f"""s{i} AS (
  SELECT c, list(mean ORDER BY place) AS m
  FROM (SELECT best[2] AS c, place, CAST(floor(CAST(sum(v[place]) AS DOUBLE) / count(*)) AS BIGINT) AS mean
        FROM a{i}, (SELECT unnest(range(1, 65)) AS place) GROUP BY ALL)
  GROUP BY c
)""")
        ctes.append(f"c{i + 1} AS (SELECT old.c, coalesce(new.m, old.m) AS m FROM c{i} old LEFT JOIN s{i} new ON old.c = new.c)")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT a.vec_id, CAST(a.best[2] AS INTEGER) AS cluster, a.best[1] AS distance,
       CAST(sum(a.best[1]) OVER (PARTITION BY a.best[2]) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.best[1]) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.m, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best[2]"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express."""
    return {
        "op12_fill_in_middle": _fill_in_middle_sql(),
        "op13_centroid_clustering": _centroid_clustering_sql(),
    }
