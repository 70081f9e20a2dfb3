from __future__ import annotations

import pytest

#: Extra columns whose names clash with the real ones except for case.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, Text string, DOC_ID long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text) pairs (or longer rows) -> documents with extra columns that clash."""

    def make(rows, lang="en", source="s0"):
        full = [(r[0], r[1], r[2] if len(r) > 2 else lang, r[3] if len(r) > 3 else source, None if r[1] is None else len(r[1]), "other", -1) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


#: Null, empty, blank, short, very long, repeated and odd texts.
EDGES = [(0, None), (1, ""), (2, " \n\t"), (3, "a"), (4, "one two"), (5, "x" * 5000), (6, "word " * 30000), (7, "same text here again"), (8, "same text here again"), (8, "same text here again"), (None, "no id"), (None, None), (9, "<|endoftext|> \u0001\u0002 é 日本 😀")]


@pytest.fixture(scope="session")
def edges(make_docs):
    return make_docs(EDGES)


@pytest.fixture(scope="session")
def empty(make_docs, spark):
    return make_docs(EDGES).limit(0)
