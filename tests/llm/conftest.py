import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def table(spark):
    """Makes documents from texts, or from (id, text) pairs, or from whole rows."""
    from vectorloom.llm.common import prepare

    prepare(spark)

    def make(rows, extra=""):
        full = []
        for k, row in enumerate(rows):
            if not isinstance(row, tuple):
                row = (k, row)
            if len(row) == 2:
                row = (*row, "en", "src0", None if row[1] is None else len(row[1]))
            full.append(row)
        return spark.createDataFrame(full, DOCUMENT + extra)

    return make


@pytest.fixture
def odd(spark):
    """Documents with nulls in every column, empty and long texts, equal rows and clashing extra columns."""
    from vectorloom.llm.common import prepare

    prepare(spark)
    words = [f"w{k % 97}x{k % 13}" for k in range(6000)]
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (None, "one two three four", None, "b", 18),
        (None, None, None, None, None), (5, "same text here for all", "de", "a", 22), (5, "same text here for all", "de", "a", 22),
        (6, "same text here for all", "de", "a", 22), (7, " ".join(words), "fr", "", 100), (8, "ünï çödé 日本 😀 x y", "", "b", 20), (9, "a", "en", "a", 1),
    ]
    clash = ", size bigint, rank bigint, fp bigint, _row string, _k1 string, slot string, word string, kind string, cell string, pair string, `odd name` string"
    return spark.createDataFrame([(*r, 7, 7, 7, "x", "x", "x", "x", "x", "x", "x", "x") for r in rows], DOCUMENT + clash)


@pytest.fixture
def nothing(spark):
    from vectorloom.llm.common import prepare

    prepare(spark)
    return spark.createDataFrame([], DOCUMENT)
