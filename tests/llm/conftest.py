import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def docs_of(spark):
    """A documents table from texts, ids from 0; None is a null text."""

    def make(texts, extra=False):
        rows = [(i, t, "en", "src0", len(t) if t else 0) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
