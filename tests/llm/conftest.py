from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path


@pytest.fixture()
def documents(spark):
    """Frames of (doc_id, text) with columns whose names clash with those the operators make."""

    def make(rows):
        rows = [(i, t, "x", 1.0, 2, "k") for i, t in rows]
        return spark.createDataFrame(
            rows, "doc_id long, text string, length string, score double, shard int, `text_sha256` string"
        )

    return make


#: Nulls, empty and blank texts, ties, repeated rows, a null id, and one very long text.
EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (None, "one  two"), (None, None),
    (5, "Naïve café 中文 <|endoftext|> it's 12³"), (6, "long word " * 30_000), (7, "x" * 3_000),
]
