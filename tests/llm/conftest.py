import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang) rows, with columns that clash with what operators add."""

    def make(rows, clash=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            for c in ("score", "n", "v", "text_hash", "component_id", "slot", "row", "piece", "length"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make
