from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"


@pytest.fixture
def docs(spark):
    """make(rows of (doc_id, text) or (doc_id, text, source)): documents with extra, clashing columns."""

    def make(rows, source="s"):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else source, None, "x", None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


ODD_TEXTS = [None, "", " ", "\n\n", "a", "A a\tB", "Été ÉTÉ", "\U0001f600 中文", "x" * 70_000, "word " * 30_000, "\x00\x1c\x85 \xa0.", "<|endoftext|> a  <|endoftext|>"]


@pytest.fixture
def odd(docs):
    """Odd texts, each twice, under ids of which one is null."""
    rows = [*enumerate(ODD_TEXTS), *((100 + k, t) for k, t in enumerate(ODD_TEXTS)), (None, "n")]
    return docs(rows)


@pytest.fixture
def none(docs):
    return docs([])
