import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) pairs, with columns whose names clash with internal ones."""

    def make(pairs, source="src0"):
        rows = [(i, t, "en", source if isinstance(source, str) else source(i), None if t is None else len(t), "x", 7) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS + ", row string, block int")

    return make
