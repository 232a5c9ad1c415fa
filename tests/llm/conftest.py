import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

LONG_WORD = "a" * 150_000
LONG_TEXT = "some words of a long text that goes on. " * 8_000
TEXTS = [None, "", "   ", "\n\n", "one", LONG_WORD, LONG_TEXT, "Same text here, twice over and over.", "Same text here, twice over and over."]
# Columns whose names operators use themselves.
EXTRA = ("row", "words", "line", "at", "n", "node", "score", "labels", "copy", "position", "n_removed", "n_words", "kept", "n_tokens", "ids", "key", "shard")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names."""
    fields = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in EXTRA)
    rows = [(i, t, "en", f"s{i % 3}", 1, *EXTRA) for i, t in enumerate(TEXTS)]
    rows += [rows[7], (None,) * (5 + len(EXTRA)), (None, "no id", None, None, None, *EXTRA)]
    return spark.createDataFrame(rows, T._parse_datatype_string(fields)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
