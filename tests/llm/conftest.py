from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, copies, repeated ids, clashing extra columns."""
    long_text = "the quick brown fox jumps over a lazy dog and runs away from the old house " * 400
    rows = [
        (1, "The cat sat on the mat, and mail me at a.b@mail.example.com today.", "en", "s", 1),
        (2, "The cat sat on the mat, and mail me at a.b@mail.example.com today.", "en", "s", 1),
        (3, None, None, None, None),
        (4, "", "en", None, 0),
        (5, " \n\t ", None, "s", 3),
        (6, long_text, "en", "s", len(long_text)),
        (6, "a different text under a repeated id", "en", "s", 1),
        (None, "no id, call +1 (555) 123-4567 or 4111 1111 1111 1111 now", "en", "s", 1),
        (8, "ein anderer Text mit der Zahl 10.0.0.1 und é😀 ひらがな", "de", "s", 1),
        (9, "x" * 5000, "en", "s", 5000),
    ]
    clash = "'q' as score, 'q' as component_id, 'q' as fp, 'q' as text_hash, 'q' as _words, 'q' as length"
    return spark.createDataFrame(rows, DOCS).selectExpr("*", *clash.split(", ")).coalesce(2)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
