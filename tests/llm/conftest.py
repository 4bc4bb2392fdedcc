import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DOC = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY, BLANK, LONG = "", " \t\n ", "lorem ipsum dolor " * 30_000


@pytest.fixture()
def write(spark, tmp_path):
    """Writes rows as a table in a fresh folder and returns the folder."""

    def put(rows, name="documents", schema=DOC, parts=3):
        spark.createDataFrame(rows, schema).repartition(parts).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put


@pytest.fixture()
def odd_docs():
    """Nulls in every column, blank and very long texts, ties, repeated rows."""
    return [
        (1, "Hello  there world again", "en", "a", 24), (2, "hello there\tworld again", "en", "a", 23), (3, "Hello there\nworld again", None, None, None),
        (4, None, None, None, None), (5, EMPTY, "en", "a", 0), (6, BLANK, "en", "b", 4), (7, LONG, "en", "b", len(LONG)), (8, LONG + "x", "en", "b", 1),
        (9, "one two", "de", "c", 7), (9, "one two", "de", "c", 7), (10, "ONE two", "de", "c", 7), (11, "Straße ÄÖÜ ﬁ", "de", "c", 9), (None, "one two", "de", "c", 7),
    ]
