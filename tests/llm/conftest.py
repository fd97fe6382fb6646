import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools"), os.path.dirname(os.path.abspath(__file__))]
# The workers import the package by name.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from llm_tables import DOCUMENTS  # noqa: E402


@pytest.fixture
def odd(spark):
    """NULLs in every column, empty, blank, repeated and very long texts, and columns with names of results."""
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(1, None, None, None, None), (None, "a text without an id", "en", None, 20), (2, "", "en", "s", 0),
            (3, " \n\t ", "en", "s", 4), (4, "x", "en", "s", 1), (4, "x", "en", "s", 1), (5, long, "en", "s", len(long)),
            (6, long, None, "s", len(long)), (7, "日本語 😀 ﬁ é́\0", "ja", "s", 9)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    for name in ("kept", "words", "content", "base", "n", "score", "key", "place", "x", "found", "lines", "_found"):
        df = df.withColumn(name, df.source)
    return df
