from __future__ import annotations

import pytest
from odd_texts import ODD_TEXTS

@pytest.fixture(scope="session")
def odd_docs(spark):
    """The odd texts under names that clash with those the operators use inside."""
    rows = [(i, t, "hash", i, "x", 7) for i, t in ODD_TEXTS]
    names = "doc_id long, text string, hash string, _group long, _part string, n_chars long"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
