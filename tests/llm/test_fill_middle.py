"""Fill-in-middle: the wavelet matrix, cuts and round trips against direct Python."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from sessionflow.llm import fill_middle as fim
from sessionflow.llm import queries
from tests.compare import compare_one, duck

SF = "/root/testdata/sf0.001"


def _expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_wavelet_ranks_equal_counts():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 4, size).astype(np.uint8)
        matrix, at = fim.WaveletMatrix(symbols, 2), np.arange(size + 1)
        for s in range(4):
            want = np.concatenate([[0], np.cumsum(symbols == s)])
            assert matrix.rank(s, at).tolist() == want.tolist()


def test_places_of_units():
    r = random.Random(5)
    texts = ["", "a", "ab", "1", " ", "ab cd", "abc", "é", "aéb", "ab1\n\n😀cd<x>"]
    texts += ["".join(r.choice("abZ 1\n.éß😀") for _ in range(r.randint(0, 90))) for _ in range(200)]
    units = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    found = fim.Units(texts)
    assert found.counts().tolist() == [len(u) for u in units]
    for share in (0.0, 0.3, 0.7, 1.0):
        wanted = np.array([int(share * len(u)) for u in units])
        want = [len("".join(u[:w])) for u, w in zip(units, wanted, strict=True)]
        assert found.places(wanted).tolist() == want


def _check(rows, texts):
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == _expected(r.doc_id, texts(r))
        assert r.restored == (texts(r) or "")


def test_forms_equal_definition(spark, small_docs, edge_docs, no_docs):
    marked = small_docs.select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("a<S>b"))).otherwise(F.col("text")).alias("text"))
    for docs in (marked, edge_docs):
        out = fim.fill_middle(docs).withColumn("restored", fim.restore(F.col("output"), F.col("form")))
        rows = out.collect()
        assert len(rows) == docs.count() and set(docs.columns) <= set(out.columns)
        _check(rows, lambda r: r.text)
    assert {"plain", "psm", "spm"} == {r.form for r in fim.fill_middle(small_docs).collect()}
    assert fim.fill_middle(no_docs).count() == 0


def test_half_sentinels_are_restored(spark):
    """Parts that end or begin like a sentinel cannot be taken for one."""
    texts = ["<S", "P>", "<", "<<P", "S><", "a<M", "><S <P M>", "<P<S<M>"]
    rows = [(i, "".join(random.Random(i).choices(texts[:7], k=12))) for i in range(400)]
    rows = [(i, t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fim.fill_middle(docs, plain_pct=0).withColumn("restored", fim.restore(F.col("output"), F.col("form")))
    for r in out.collect():
        assert r.restored == r.text


def test_long_text(spark):
    text = ("word " * 1_000_000) + "é" * 1_000_000
    docs = spark.createDataFrame([(7, text)], "doc_id long, text string")
    out = fim.fill_middle(docs).withColumn("restored", fim.restore(F.col("output"), F.col("form")))
    _check(out.collect(), lambda r: r.text)


def test_query_equals_sql(spark):
    name = "op12_fill_in_middle"
    done = compare_one(spark, duck(SF), name, queries.queries()[name], queries.oracle_sql()[name], SF)
    assert done["match"] and done["types_match"], done
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
